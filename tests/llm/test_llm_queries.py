"""The registered queries against their SQL, and the pipeline stage by stage."""

import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, oracle_connection

import corpus_pipeline
from hodos.llm import mixing, quality
from hodos.session import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(corpus_pipeline.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    ok, detail = compare(spark, name, corpus_pipeline.QUERIES[name], corpus_pipeline.ORACLES[name], oracle, SF)
    assert ok, detail


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in corpus_pipeline.QUERIES if n != "pipeline") == list(range(1, 14))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def leaks(text, items):
    """Whether some window as long as an item has the item's weighted 5-grams, 0.8 or more."""
    w = WORD.findall(text or "")
    own = shingles(text)
    for item in items:
        n = len(item)
        if not own & shingles(" ".join(item)):
            continue
        for i in range(max(1, len(w) - n + 1)):
            a, b = (Counter(tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))) for x in (item, w[i : i + n]))
            if w and sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9:
                return True
    return False


def test_pipeline_stages_equal_brute_force(spark):
    """Every stage on a small corpus of good, bad, copied, nearly copied and contaminated texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    keep = lambda frame: (frame.write.parquet(to := scratch(spark, "stage")), spark.read.parquet(to))[1]
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    given = rows(docs)

    # 1: the rows whose score, worked out text by text, reaches the limit; the labelled ones come out right
    net = quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = keep(stages["quality_classifier"](spark, docs, SF))
    assert accepted.columns == columns
    score = {t: float(forward(net, (t or "").encode())) for t in {r[1] for r in given}}
    assert rows(accepted) == [r for r in given if score[r[1]] >= quality.ACCEPT]

    # 2: one row of each connected class, the one of the least id
    once = keep(stages["ngram_jaccard_join"](spark, accepted, SF))
    left = rows(accepted)
    sets, root = {r[0]: shingles(r[1]) for r in left}, {r[0]: r[0] for r in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(root)
    for i in ids:
        for j in ids:
            if i < j and similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [r for r in left if not sets[r[0]] or find(r[0]) == r[0]]
    assert once.columns == columns and rows(once) == want and len(want) < len(left)

    # 3: no row with a benchmark item, all others
    items = [WORD.findall(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = keep(stages["benchmark_decontamination"](spark, once, SF))
    want = [r for r in rows(once) if not leaks(r[1], [i for i in items if i])]
    assert clean.columns == columns and rows(clean) == want and len(want) < once.count()

    # 4: rows of the input alone, each at most twice, the words of a source near its target
    mixed = keep(stages["source_mixing"](spark, clean, SF))
    times = Counter(rows(mixed))
    assert mixed.columns == columns and set(times) <= set(rows(clean)) and max(times.values()) <= 2
    goal = {r.source: r.target for r in mixing.mixed(clean).select("source", "target").distinct().collect()}
    longest = max(len(WORD.findall(r[1] or "")) for r in rows(clean))
    for source, target in goal.items():
        words = sum(n * len(WORD.findall(r[1] or "")) for r, n in times.items() if r[columns.index("source")] == source)
        assert int(target) <= words <= target + longest

    # 5: every token id of every row, at slots without gaps
    placed = stages["training_order"](spark, mixed, SF)
    assert placed.count() == placed.select("slot").distinct().count() == placed.agg({"slot": "max"}).first()[0] + 1


def forward(net, text):
    """The network on one text, window by window."""
    w = net.weights
    step, size = quality.STEP, quality.CHUNK
    n = 1 if len(text) <= size else 1 + -(-(len(text) - size) // step)
    pooled = []
    for c in range(n):
        chunk = np.frombuffer(text[c * step : c * step + size].ljust(size, b"\0"), np.uint8)
        windows = sum(w["filters"][j][chunk[j : size - quality.WIDTH + 1 + j]] for j in range(quality.WIDTH))
        pooled.append(np.maximum(windows.max(0) + w["bias"], 0))
    features = np.r_[np.mean(pooled, 0), np.max(pooled, 0)]
    return 1 / (1 + np.exp(-float(features @ w["top"] + w["offset"][0])))


def test_forward_pass_equals_window_by_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [b"", b"abc", b"x" * 512, b"y" * 513, *[(r.text or "").encode() for r in docs.limit(40).collect()]]
    assert np.abs(net.score(texts) - [forward(net, t) for t in texts]).max() < 1e-5
