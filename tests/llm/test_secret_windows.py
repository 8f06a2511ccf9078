"""Secret scan against plain loops on random texts, and on long unbroken runs."""

import re
import time

import numpy as np
from strikelake.llm import secrets

KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RULE = secrets.EntropyRule()


def bits(window):
    counts = np.array([window.count(c) for c in set(window)])
    return float(-(counts / len(window) * np.log2(counts / len(window))).sum())


def expected(text):
    base = []
    for order, kind, pattern in ((0, "assign", secrets.ASSIGN), (1, "access", secrets.ACCESS), (2, "hex", secrets.HEX)):
        base += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text) if order or len(m[1]) >= secrets.ASSIGN_LEAST]
    found = list(base)
    for run in re.finditer(rf"[A-Za-z0-9+/_=-]{{{RULE.window},}}", text):
        if not (re.search("[0-9]", run[0]) and re.search("[A-Za-z]", run[0])):
            continue
        covered = np.zeros(len(run[0]), bool)
        for start, _, end, _ in base:
            covered[max(0, start - run.start()) : max(0, end - run.start())] = True
        for word in re.finditer(RULE.allow_words, run[0]):
            covered[word.start() : word.end()] = True
        for part in re.finditer(rf"0{{{RULE.window},}}", "".join("1" if c else "0" for c in covered)):
            value, at = run[0][part.start() : part.end()], run.start() + part.start()
            if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)) or any(re.search(a, value) for a in RULE.allow):
                continue
            is_hex = re.fullmatch("[0-9A-Fa-f]+", value)
            least = RULE.hex_bits if is_hex else RULE.base64_bits
            hits = [i for i in range(len(value) - RULE.window + 1) if bits(value[i : i + RULE.window]) >= least - 1e-9]
            if hits:
                found.append((at + hits[0], 3, at + hits[-1] + RULE.window, "entropy_hex" if is_hex else "entropy_base64"))
    return sorted(found)


def scanned(spark, texts):
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [[(s.start, s.ord, s.end, s.kind) for s in r.secret_spans] for r in rows]


def test_random_texts_equal_plain_loops(spark):
    rng = np.random.default_rng(11)
    key = lambda n, alphabet=KEYS: "".join(rng.choice(list(alphabet), n))
    bricks = [
        lambda: key(int(rng.integers(1, 70))), lambda: key(int(rng.integers(10, 60)), "0123456789abcdef"), lambda: key(40, "ABCDEF0123456789"),
        lambda: "AKIA" + key(int(rng.integers(10, 20)), "ABCDEFGHJK234"), lambda: f"api_key = '{key(20)}'", lambda: "Token:secret:" + key(15),
        lambda: "sample", lambda: "a" * 30, lambda: "é\n", lambda: " ", lambda: " ", lambda: "naïve words", lambda: key(30, "ab1"),
    ]
    texts = ["".join(bricks[i]() for i in rng.integers(0, len(bricks), rng.integers(1, 14))) for _ in range(150)]
    wanted = [expected(t) for t in texts]
    assert scanned(spark, texts) == wanted
    assert {k for spans in wanted for *_, k in spans} == {"assign", "access", "hex", "entropy_hex", "entropy_base64"}


def test_allowed_words_leave_the_rest_of_a_run(spark):
    key = "kJ8xPq2Zr7Lm4Tn9Vb3Ws6YdQc5Hf1"
    for spans in scanned(spark, [f"sample_db_key={key}", f"host/example/{key}"]):
        assert [s[3] for s in spans] == ["entropy_base64"]


def test_many_matches_in_one_text(spark):
    text = "0123456789abcdef " * 3000
    assert scanned(spark, [text])[0] == [(17 * i, 2, 17 * i + 16, "hex") for i in range(3000)]


def test_long_runs_take_linear_time(spark):
    rng = np.random.default_rng(5)
    took = []
    scanned(spark, ["".join(rng.choice(list(KEYS), 2_000))])
    for size in (50_000, 1_000_000):
        run = "".join(rng.choice(list(KEYS), size))
        start = time.perf_counter()
        spans = scanned(spark, [run])[0]
        took.append(time.perf_counter() - start)
        left = [s for s in spans if s[1] == 3]
        assert left and left[0][0] < 100 and left[-1][2] > size - 100
    assert took[1] < 60 * max(took[0], 0.5)  # twenty times the size
