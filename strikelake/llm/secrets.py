"""Secret scan: pattern spans plus spans of high entropy, all in column expressions.

Each pattern cuts a text into pieces that end with a match, so positions are running sums of piece lengths. Entropy
candidates are unbroken runs of key characters, without the parts that a pattern span or an allow-listed word covers. A
window of WINDOW characters slides over a candidate; its Shannon entropy follows from incremental counts (one character
enters, one leaves, the sum of c*log2(c) is corrected for both). Counts are packed into a few longs and the sum is in
fixed point, so a step costs the same at every position and no rounding adds up. Each candidate has one character class,
hexadecimal or base64, with its own bound. Candidates that look like prose, paths or counters as a whole are dropped.

Defined cases: null or empty text has no spans; spans are code points, end exclusive; a pattern span is not reported
again, what is left of its run on either side is; a candidate longer than the window is reported from its first to its
last window above the bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the contract: kind, pattern, tail that must have a least length, least length. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Key characters lie between these ASCII codes.
FIRST_CODE, LAST_CODE = ord("+"), ord("z")
#: Words that are cut out of a run, and shapes of a whole candidate that are no key.
ALLOW_WORDS = r"(?i:example|sample|dummy|placeholder|xxxx|abcdefgh|01234567|12345678)"
ALLOW = (r"^[A-Za-z]+$", r"^[0-9=_+/-]+$", r"^(?:[a-z]+[/_-])+[a-z0-9]*$")
#: Items of a block in running totals, and code points of a bin of base spans: with them texts of many matches stay cheap.
BLOCK, BIN = 128, 4096
#: Fixed point of the sum of c*log2(c).
UNIT = 1 << 40


@dataclass(frozen=True)
class EntropyRule:
    window: int = 20
    base64_bits: float = 3.9
    hex_bits: float = 2.9
    allow: tuple[str, ...] = ALLOW
    allow_words: str = ALLOW_WORDS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut after every match; the last pieces have none. The end anchor keeps the scan linear."""
    return F.regexp_extract_all(text, F.lit(r"[\s\S]*?(?:" + pattern + r"|\z)"), F.lit(0))


def _running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """array<struct<before, item>>: each item with its predecessors' values combined, from 0.

    A fold copies its whole state at each step, so that one which collects is quadratic; here blocks are combined first,
    then the items of each block.
    """
    total = lambda rows, zero: F.aggregate(rows, zero, lambda acc, x: combine(acc, value(x)))

    def within(blocks: Column, totals: Column) -> Column:
        def block(rows: Column, k: Column) -> Column:
            carried = F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), combine)
            return _let(carried, lambda zero: F.transform(rows, lambda x, j: F.struct(total(F.slice(rows, F.lit(1), j), zero).alias("before"), x.alias("item"))))

        return F.flatten(F.transform(blocks, block))

    def cut(rows: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda start: F.slice(rows, start, F.lit(BLOCK)))
        return _let(blocks, lambda made: _let(F.transform(made, lambda b: total(b, F.lit(0))), lambda totals: within(made, totals)))

    return _let(items, cut)


def _located(text: Column, pattern: str, kind: str, order: int, group_least: int | None = None) -> Column:
    """array<struct<start, ord, end, kind, value>> of the matches of a pattern."""

    def matched(piece: Column) -> Column:
        def described(value: Column) -> Column:
            good = value != ""
            if group_least:
                good = good & (F.char_length(F.regexp_extract(value, pattern, 1)) >= group_least)
            return F.struct(F.char_length(piece).alias("step"), F.char_length(value).alias("size"), value.alias("value"), good.alias("good"))

        return _let(F.regexp_extract(piece, pattern, 0), described)

    def span(r: Column) -> Column:
        end = r["before"] + r["item"]["step"]
        return F.struct((end - r["item"]["size"]).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), r["item"]["value"].alias("value"))

    placed = _running(F.transform(_pieces(text, pattern), matched), lambda m: m["step"], lambda a, b: a + b)
    return F.transform(F.filter(placed, lambda r: r["item"]["good"]), span)


def _window_span(value: Column, rule: EntropyRule, bits: Column) -> Column:
    """struct<first, last>: starts of the first and last window of ``value`` whose entropy reaches ``bits``, or -1.

    State: counts per character code packed into longs, the sum of c*log2(c), first and last hit. Entropy of a full window
    of w characters is log2(w) - sum / w.
    """
    w = rule.window
    width = w.bit_length()
    per_long = 62 // width
    longs = (LAST_CODE - FIRST_CODE) // per_long + 1
    clog = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(w + 1)])
    one = F.lit(1).cast("long")
    shifted = lambda by: F.call_function("shiftleft", one, by)

    def place(code: Column, name: str) -> list[Column]:
        return [F.floor(code / per_long).cast("int").alias(f"{name}_long"), (code % per_long * width).alias(f"{name}_bit")]

    def steps(codes: Column) -> Column:
        def step(code: Column, i: Column) -> Column:
            gone = F.get(codes, i - w)
            return F.struct(i.alias("i"), (code == gone).alias("same"), *place(code, "new"), *place(gone, "gone"))

        return F.transform(codes, step)

    def slide(acc: Column, e: Column) -> Column:
        count = lambda name: F.call_function("shiftright", F.get(acc["n"], e[f"{name}_long"]), e[f"{name}_bit"]).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")

        def next_state(s: Column) -> Column:
            start = e["i"] - (w - 1)
            hit = (start >= 0) & (F.lit(float(w * UNIT)) * (F.lit(math.log2(w)) - bits) + w >= s)
            counts = F.when(F.coalesce(e["same"], F.lit(False)), acc["n"]).otherwise(
                F.transform(
                    acc["n"],
                    lambda c, j: c
                    + F.when(j == e["new_long"], shifted(e["new_bit"])).otherwise(F.lit(0))
                    - F.when(j == e["gone_long"], shifted(e["gone_bit"])).otherwise(F.lit(0)),
                )
            )
            return _let(
                hit,
                lambda h: F.struct(
                    counts.alias("n"),
                    s.alias("s"),
                    F.when(h & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"),
                    F.when(h, start).otherwise(acc["last"]).alias("last"),
                ),
            )

        def moved(k: Column) -> Column:
            enters = F.get(clog, k["new"] + 1) - F.get(clog, k["new"])
            leaves = F.coalesce(F.get(clog, k["gone"]) - F.get(clog, k["gone"] - 1), F.lit(0).cast("long"))
            return F.when(F.coalesce(e["same"], F.lit(False)), acc["s"]).otherwise(acc["s"] + enters - leaves)

        return _let(_let(F.struct(count("new").alias("new"), count("gone").alias("gone")), moved), next_state)

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - FIRST_CODE)
    return F.aggregate(_let(codes, steps), zero, slide, lambda done: F.struct(done["first"].alias("first"), done["last"].alias("last")))


def _parts(run: Column, binned: Column, rule: EntropyRule) -> Column:
    """array<struct<start, value>>: what pattern spans and allow-listed words leave of a run, where a window fits."""
    first, last = F.floor(run["start"] / BIN).cast("int"), F.floor(run["end"] / BIN).cast("int")
    spans = F.filter(F.flatten(F.slice(binned, first + 1, last - first + 1)), lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    near = F.transform(spans, lambda b: F.struct((b["start"] - run["start"]).alias("start"), (b["end"] - run["start"]).alias("end")))
    words = F.transform(_located(run["value"], rule.allow_words, "allowed", 0), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    size = run["end"] - run["start"]
    cuts = F.concat(F.array_sort(F.concat(near, words)), F.array(F.struct(size.alias("start"), size.alias("end"))))
    gaps = F.filter(_running(cuts, lambda c: c["end"], lambda a, b: F.greatest(a, b)), lambda r: r["item"]["start"] - r["before"] >= rule.window)
    chars = F.split(run["value"], "")
    text = lambda r, c: F.array_join(F.slice(c, r["before"] + 1, r["item"]["start"] - r["before"]), "")
    whole = (F.size(cuts) == 1) & (size >= rule.window)
    return F.when(whole, F.array(F.struct(run["start"].alias("start"), run["value"].alias("value")))).otherwise(
        _let(chars, lambda c: F.transform(gaps, lambda r: F.struct((run["start"] + r["before"]).alias("start"), text(r, c).alias("value"))))
    )


def entropy_spans(text: Column, base: Column, rule: EntropyRule) -> Column:
    """Spans of entropy candidates outside ``base`` spans."""
    # Prose has no digits within a word, so that such runs go before anything is computed of them.
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    runs = F.filter(_located(text, rf"[A-Za-z0-9+/_=-]{{{rule.window},}}", "entropy", 3), lambda c: mixed(c["value"]))
    bins = F.sequence(F.lit(0), F.floor(F.char_length(text) / BIN).cast("int"))
    binned = lambda known: F.transform(bins, lambda k: F.filter(known, lambda b: (b["start"] < (k + 1) * BIN) & (b["end"] > k * BIN)))
    parts = _let(_let(base, binned), lambda known: F.flatten(F.transform(runs, lambda run: _parts(run, known, rule))))
    allowed = "|".join(f"(?:{pattern})" for pattern in rule.allow)
    kept = F.filter(parts, lambda c: mixed(c["value"]) & ~c["value"].rlike(allowed))

    def scored(c: Column) -> Column:
        def within(is_hex: Column) -> Column:
            span = _window_span(c["value"], rule, F.when(is_hex, F.lit(rule.hex_bits)).otherwise(F.lit(rule.base64_bits)))
            return F.struct(c["start"].alias("from"), span.alias("hit"), F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64")).alias("kind"))

        return _let(c["value"].rlike("^[0-9A-Fa-f]+$"), within)

    hits = F.filter(F.transform(kept, scored), lambda c: c["hit"]["first"] >= 0)
    return F.transform(
        hits,
        lambda c: F.struct(
            (c["from"] + c["hit"]["first"]).alias("start"),
            F.lit(3).alias("ord"),
            (c["from"] + c["hit"]["last"] + rule.window).alias("end"),
            c["kind"].alias("kind"),
        ),
    )


def scan(docs: DataFrame, text_col: str = "text", rule: EntropyRule = EntropyRule(), out: str = "secret_spans") -> DataFrame:
    """Adds ``out``: array<struct<start, ord, end, kind>> sorted by start, then kind as listed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = F.concat(
        slim(_located(text, ASSIGN, "assign", 0, ASSIGN_LEAST)), slim(_located(text, ACCESS, "access", 1)), slim(_located(text, HEX, "hex", 2))
    )
    found = docs.withColumn(out, base)
    return found.withColumn(out, F.array_sort(F.concat(F.col(out), entropy_spans(text, F.col(out), rule))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
