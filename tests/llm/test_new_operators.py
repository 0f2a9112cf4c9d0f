"""Whitening, conversation repair and exact top-k against brute force, and on odd and empty tables."""

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hodos.llm import repair, topk, whitening
from hodos.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# --- embedding whitening ---------------------------------------------------------------


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def test_whitening_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if usable(r.embedding)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(np.cov((n * fit - sums).T / n, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :16] / np.sqrt(values[:16])
    got = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(got) == 16 * len(rows)
    place = {v: i for i, (v, _) in enumerate(rows)}
    table = np.full((len(rows), 16), np.nan)
    for r in got:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == sum(int(d) ** 2 for d in n * x[place[r.vec_id]] - sums)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    signs = np.sign((table * want).sum(0))
    assert np.abs(table - signs * want).max() < 1e-7


@pytest.mark.parametrize("gaps", [0.0, 1e-9, 1e-13])
def test_refinement_of_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    values = np.sort(np.r_[5 + gaps * np.arange(6), 2 + gaps * np.arange(4), rng.uniform(0.1, 1, 20)])[::-1]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13
    assert np.abs(x.T @ x - np.eye(30)).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 1e-13
    if gaps == 1e-9:  # single precision cannot tell these apart, the refinement has to
        start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(float)
        assert np.abs(np.abs(start.T @ x) - np.eye(30)).max() > 0.1
        assert np.abs(np.abs(np.linalg.eigh(a)[1][:, ::-1].T @ x) - np.eye(30)).max() < 1e-5


def test_refinement_corrects_single_precision():
    rng = np.random.default_rng(6)
    a = np.cov(rng.normal(size=(64, 500)))
    single = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(float)
    values, x = whitening.refined(a)
    error = lambda v: np.abs(a @ v - v * np.einsum("ij,ij->j", v, a @ v)).max()
    assert error(x) < 1e-14 < 1e-8 < error(single)


def vectors(spark, rows, extra=True):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return frame.withColumns({c: F.lit("x") for c in ("x", "v", "row", "score", "rank", "n", "whitened")}) if extra else frame


ODD = [(1, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, None, 0), (3, [0.1, None], 0), (4, [float("nan"), 0.1], 0), (5, [float("inf"), 1.0], 0), (None, [-0.5, 0.75], None), (20, [0.9, -0.3], 2), (40, [0.5, 0.25], 1), (60, [0.25], 1), (7, [], 1), (8, [-0.2, -0.7], 1)]


def saved(spark, frame, folder, name):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_whitening_of_odd_rows(spark, folder):
    got = QUERIES["op11_embedding_whitening"](spark, saved(spark, vectors(spark, ODD), folder, "embeddings")).collect()
    kept = [(i, v) for i, v, _ in ODD if usable(v) and len(v) == 2]
    assert len(got) == 2 * len(kept) and {r.n for r in got} == {4}
    assert sorted((r.vec_id is None, r.vec_id) for r in got) == sorted((i is None, i) for i, _ in kept for _ in range(2))
    assert all(r.identity_error < 1e-12 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25], 1)] * 3, [(1, None, 1)], [(1, [], 1)]])
def test_whitening_without_spread(spark, folder, rows):
    frame = QUERIES["op11_embedding_whitening"](spark, saved(spark, vectors(spark, rows), folder, "embeddings"))
    assert frame.count() == 0 and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [0, 5]), (2, [1 << 40, 3])], "vec_id long, x array<long>")
    model = whitening.fitted(rows)
    big = {**model, "n": 1 << 20, "sums": np.zeros(2, np.int64)}
    got = {r.vec_id: int(r.deviation) for r in whitening.transformed(rows, big).collect()}
    assert got == {1: 25 << 40, 2: (1 << 120) + (9 << 40)}


# --- conversation repair ----------------------------------------------------------------

SPACE = "\x20\t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by exploring partial edits in order of cost and letters."""
    accepted = re.compile(r"(s?(ua)+)?")
    best, heap, done = None, [(0, "", 0, 0, ())], set()
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and state in (0, 3):
            assert accepted.fullmatch("".join(r[0] for r, _ in kept))
            best = (cost, audit, kept) if best is None or audit < best[1] else best
        if (cost, audit, i, state) in done:
            continue
        done.add((cost, audit, i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in follow and audit[-6:] != "I" * 6:
                heapq.heappush(heap, (cost + 3, audit + "I", i, follow[state, role[0]], (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, role[:1]) in follow:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, follow[state, role[:1]], (*kept, (role, text))))
                for other in ("user", "assistant"):
                    if (state, other[0]) in follow:
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, follow[state, other[0]], (*kept, (other, text))))
    return best


def faults_of(rows):
    """(role, text, fault) of the rows of one conversation in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_digest(rows):
    named = faults_of(rows)
    cost, audit, kept = cheapest(named)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(named, named[1:])]
    count = lambda f: sum(r[2] == f for r in named)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def brute_repair(given):
    by = defaultdict(list)
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = by[conv]
        text = "" if drawn == 1 else re.sub("[.!?]", "", text) if drawn == 2 else text
        role = "user" if drawn == 4 else role
        if drawn:
            rows += [(turn, role, text)] * (2 if drawn == 3 else 1)
    return {conv: brute_digest(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, rows in by.items()}


def digest_of(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_conversation_repair_equals_brute_force(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert digest_of(QUERIES["op12_conversation_repair"](spark, SF)) == brute_repair(given)


def test_repair_of_random_and_odd_conversations(spark, folder):
    import random

    pick = random.Random(4)
    given = []
    for conv in range(120):
        for _ in range(pick.randrange(1, 9)):
            turn = pick.choice([None, *range(12)])
            role = pick.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "Über"])
            given.append((conv if conv else None, turn, role, pick.choice(["A b.", "c!", "d", " ", None, "é?", "A b.", "line\nline. \n", "x" * 30_000])))
    frame = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("fault", "gone", "edit", "place", "drawn", "copy", "earlier")})
    got = digest_of(QUERIES["op12_conversation_repair"](spark, saved(spark, frame, folder, "conversations")))
    assert got == brute_repair(given)


def test_repair_of_a_conversation_that_keeps_its_choice_open(spark, folder, monkeypatch):
    """Blocks go to the file: equal to holding all rows, and the rows are those that were given."""
    rows = [(i, ("user", "user", "assistant", "assistant", "system")[i * i % 5], f"text {i % 7}" + ("." if i % 3 else "")) for i in range(600)]
    faults = [0 if i % 4 else 3 for i in range(600)]

    def run():
        c, out = repair.Conversation(), []
        for (turn, role, text), fault in zip(rows, faults):
            out += c.add(turn, role, text, fault)
        return out + list(c.finish())

    whole = run()
    spilled = []
    monkeypatch.setattr(repair.Open, "forced", lambda self, alive: (0, -1))  # never decided early
    keep = repair.Open.spill
    monkeypatch.setattr(repair.Open, "spill", lambda self: (spilled.append(len(self.rows)), keep(self)))
    monkeypatch.setattr(repair, "HELD", 50)
    monkeypatch.setattr(repair, "OPEN", 8)
    assert run() == whole and len(spilled) > 5
    assert [r[1] for r in whole if r[4] != "I"] == list(range(600))


def test_repair_without_rows(spark, folder):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert QUERIES["op12_conversation_repair"](spark, saved(spark, empty, folder, "conversations")).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(5, gone, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = repair.digests(repair.repaired(repair.damaged(frame))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- exact top-k -----------------------------------------------------------------------


def brute_topk(rows, k, divisor):
    kept = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows if usable(v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % divisor == 0:
            scored = [(-sum(p * q for p, q in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(kept) if b != a]
            out += [(i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_topk_of_odd_rows(spark, folder):
    got = QUERIES["op13_exact_topk"](spark, saved(spark, vectors(spark, ODD), folder, "embeddings"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_topk([(i, v) for i, v, _ in ODD], 20, 20)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(20, None, 1)], [(20, [], 1), (40, [0.5], 1)]])
def test_topk_of_few_rows(spark, folder, rows):
    got = QUERIES["op13_exact_topk"](spark, saved(spark, vectors(spark, rows), folder, "embeddings"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_topk([(i, v) for i, v, _ in rows], 20, 20)


@pytest.mark.parametrize("query_rows", [7, 1 << 16])
def test_topk_in_rounds_and_groups(spark, monkeypatch, query_rows):
    """Clustered vectors with many copies: several rounds, several groups of queries, ties."""
    for name, value in (("QUERY_ROWS", query_rows), ("FIRST", 16), ("GROWTH", 3), ("PIVOTS", 8), ("RINGS", 4), ("SAMPLE", 100), ("CHUNK", 64), ("CELLS", 500)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5)) * 2
    data = np.r_[centres[rng.integers(0, 6, 350)] + rng.normal(size=(350, 5)) * 0.1, np.repeat(centres[:1], 150, 0), rng.normal(size=(5, 5)) * 40]
    rows = [(int(i) if i % 31 else None, [float(c) for c in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = frame.filter(whitening.usable(F.col("embedding"))).select("vec_id", whitening.integers(F.col("embedding")).alias("v"))
    got = topk.searched(v, F.col("vec_id") % 20 == 0, 10)
    assert sorted(map(tuple, got.collect()), key=str) == brute_topk(rows, 10, 20)


def test_annuli_out_of_reach_are_skipped(spark):
    """The bound never falls below a true product, and it does skip annuli of clustered data."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16))
    x = np.floor(64 * (centres[rng.integers(0, 8, 800)] + rng.normal(size=(800, 16)) * 0.02)).astype(np.int64)
    pivots = topk._chosen(x[:100])
    far = topk._distances(x, pivots)
    pivot, distance = far.argmin(1), far.min(1)
    groups = [(int(p), 0, int((pivot == p).sum()), distance[pivot == p].min(), distance[pivot == p].max(), int((x[pivot == p] ** 2).sum(1).max())) for p in np.unique(pivot)]
    annuli = topk.Annuli(pivots, groups)
    near = annuli.nearest(far, slice(None))
    bound = ((x**2).sum(1)[:, None] + annuli.norm[None, :] - near**2) / 2 + 1
    products = x @ x.T
    for i, g in enumerate(groups):
        assert (products[:, pivot == g[0]].max(1) <= bound[:, i]).all()
    floor = np.sort(products, axis=1)[:, -21]
    assert (bound < floor[:, None]).mean() > 0.5
