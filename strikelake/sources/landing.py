"""Landed entity tables: explicit schemas for every record type the pulls deliver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

_POSITION = "id STRING, condition STRING, outcomeIndex INT"
_FLOW = "id STRING, timestamp STRING, stakeholder STRING, condition STRING, amount STRING"
_TRADE = (
    "id STRING, marketId STRING, outcomeTokenId STRING, price STRING, size STRING, side STRING, timestamp STRING, "
    "blockNumber STRING, transactionHash STRING"
)
_PAYOUT = "id STRING, positionIds ARRAY<STRING>, payoutNumerators ARRAY<STRING>, payoutDenominator STRING"


@dataclass(frozen=True)
class Entity:
    key: str
    ddl: str

    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


# Pull name, array key in the page, and fields. Amounts arrive as text and are cast later.
ENTITIES = {
    "markets": Entity(
        "markets",
        "id STRING, conditionId STRING, question STRING, slug STRING, outcomeTokenIds ARRAY<STRING>, resolved BOOLEAN, "
        "resolvedTime STRING, createdAt STRING",
    ),
    "conditions": Entity("conditions", "id STRING"),
    "positions": Entity("positions", _POSITION),
    "positionsByTokenIds": Entity("positions", _POSITION),
    "redemptions": Entity(
        "redemptions", "id STRING, timestamp STRING, redeemer STRING, condition STRING, indexSets ARRAY<STRING>, payout STRING"
    ),
    "splits": Entity("splits", _FLOW),
    "merges": Entity("merges", _FLOW),
    "negRiskEvents": Entity("negRiskEvents", "id STRING, questionCount INT"),
    "negRiskConversions": Entity(
        "negRiskConversions",
        "id STRING, timestamp STRING, stakeholder STRING, negRiskMarketId STRING, amount STRING, indexSet STRING, questionCount INT",
    ),
    "trades": Entity("trades", _TRADE),
    "tradesByMarket": Entity("trades", _TRADE),
    "orderFilledEvents": Entity(
        "orderFilledEvents",
        "id STRING, transactionHash STRING, timestamp STRING, orderHash STRING, maker STRING, taker STRING, makerAssetId STRING, "
        "takerAssetId STRING, makerAmountFilled STRING, takerAmountFilled STRING, fee STRING",
    ),
    "ordersMatchedEvents": Entity(
        "ordersMatchedEvents",
        "id STRING, timestamp STRING, makerAssetID STRING, takerAssetID STRING, makerAmountFilled STRING, takerAmountFilled STRING",
    ),
    "orderbooks": Entity(
        "orderbooks",
        "id STRING, tradesQuantity STRING, buysQuantity STRING, sellsQuantity STRING, collateralVolume STRING, "
        "scaledCollateralVolume STRING, collateralBuyVolume STRING, scaledCollateralBuyVolume STRING, collateralSellVolume STRING, "
        "scaledCollateralSellVolume STRING",
    ),
    "marketDatas": Entity("marketDatas", _POSITION),
    "userPositions": Entity(
        "userPositions",
        "id STRING, user STRING, tokenId STRING, amount STRING, avgPrice STRING, realizedPnl STRING, totalBought STRING",
    ),
    "pnlConditions": Entity("conditions", _PAYOUT),
    "pnlConditionsById": Entity("conditions", _PAYOUT),
}


def load_entities(spark: SparkSession, path: str, name: str, multi_line: bool = True) -> DataFrame:
    """All entities of a persisted pull: page files hold one array each under the entity's key."""
    entity = ENTITIES[name]
    page = StructType().add(entity.key, ArrayType(entity.schema()))
    pages = spark.read.schema(page).option("multiLine", multi_line).json(path)
    return pages.select(F.inline(F.col(entity.key)))
