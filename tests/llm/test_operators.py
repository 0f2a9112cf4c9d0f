"""Every operator against brute force, and on odd and empty tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import prose
from pyspark.sql import functions as F

from hodos.llm import decontaminate, lines, mixing, near, order, outliers, ppm, quality, tokens, warc
from hodos.llm.bpe import END, encoder
from hodos.llm.common import shingle_hashes, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# --- helpers -------------------------------------------------------------------------


def test_word_hashes_name_words():
    texts = [b"a b  a\tc", b"", b"\n", b"a"]
    hashes, owner = word_hashes(texts)
    assert owner.tolist() == [0, 0, 0, 0, 3]
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3


def test_shingles_of_short_and_long_texts():
    hashes, owner = shingle_hashes([b"a b c d e f", b"a b c d e", b"a b", b"", b"x a b c d e"], 5)
    assert Counter(owner.tolist()) == {0: 2, 1: 1, 2: 1, 4: 2}
    assert hashes[0] == hashes[2] == hashes[5]


# --- 1 WARC --------------------------------------------------------------------------


def test_warc_round_trip_filters_and_payload(spark, folder):
    big = "<p>" + prose(5, 4000)
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (0, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (5, "u", ""), (1, "http://a/\r\nX: y", big)]
    warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)), folder)
    back = warc.read_archives(spark, folder)
    got = sorted(((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back.collect()), key=str)
    want = [(1, "response", None, big.encode())] * 2 + [(2, "revisit", 1, b""), (None, "revisit", 1, b""), (0, "response", None, b"short"), (3, "response", None, b"short"), (4, "response", None, b""), (5, "response", None, b"")]
    assert got == sorted(want, key=str)
    narrow = warc.read_archives(spark, folder, "page_id long, record_type string").filter("record_type = 'revisit'")
    assert sorted(str(r.page_id) for r in narrow.collect()) == ["2", "None"]


def test_warc_plain_and_foreign_members(tmp_path):
    import gzip

    from pyarrow import fs

    row = {"record_type": "response", "target_uri": "u", "page_id": 7, "refers_to": None, "payload_bytes": 3, "payload_digest": "d", "payload": b"abc"}
    for name, data in (("p.warc", warc.record(row) * 2), ("g.warc.gz", gzip.compress(warc.record(row)) * 2)):
        (tmp_path / name).write_bytes(data)
        with fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as source:
            assert [r["payload"] for r in warc.records(source, lambda r: True, True)] == [b"abc", b"abc"]


@pytest.mark.parametrize("kind", ["own", "foreign", "plain"])
def test_warc_cut_anywhere(tmp_path, kind):
    """A cut never hangs and never gives a shorter payload: an error, or the records before it."""
    import gzip

    from pyarrow import fs

    body = bytes(np.random.default_rng(1).integers(32, 127, 20_000, dtype=np.uint8))
    rows = [{"record_type": "response", "page_id": i, "target_uri": "u", "payload": body[i:], "payload_digest": "d", "payload_bytes": len(body) - i, "refers_to": None} for i in range(2)]
    pack = {"own": warc.member, "foreign": gzip.compress, "plain": bytes}[kind]
    first, second = (pack(warc.record(r)) for r in rows)
    local = fs.LocalFileSystem()

    def read(cut, payload, drop):
        (tmp_path / "a.warc.gz").write_bytes((first + second)[:cut])
        with local.open_input_file(str(tmp_path / "a.warc.gz")) as source:
            return [r["page_id"] for r in warc.records(source, lambda row: True, payload, drop) if not payload or r["payload"] == rows[r["page_id"]]["payload"]]

    assert read(len(first + second), True, False) == [0, 1]
    for cut in (1, 9, 30, 100, len(first) // 2, len(first) + 5, len(first) + 40, len(first) + 300, len(first + second) - 9):
        with pytest.raises(warc.DamagedArchive):
            read(cut, True, False)
        assert read(cut, True, True) == ([0] if cut > len(first) else [])
    assert read(len(first), True, False) == [0]


def test_warc_wrong_check_sum_and_mode(spark, folder):
    import os

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.archived(pages, folder)
    narrow = warc.read_archives(spark, folder, "record_type string, page_id long").filter("page_id >= 1 and page_id < 3")
    assert narrow.count() == 2 and ">= 1" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    path = folder.removeprefix("file:")
    name = next(n for n in os.listdir(path) if n.endswith(".warc.gz"))
    data = bytearray(open(f"{path}/{name}", "rb").read())
    data[len(data) - 6] ^= 1  # in the check sum of the last member
    open(f"{path}/{name}", "wb").write(data)
    with pytest.raises(Exception, match="cannot be inflated"):
        warc.read_archives(spark, folder).collect()
    assert spark.read.format("warc").schema(warc.SCHEMA).option("mode", "dropmalformed").load(folder).count() == 3


def test_warc_empty(spark, folder):
    warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


# --- 2 near copies -------------------------------------------------------------------


def shingled(text):
    w = WORD.findall(text or "")
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("crowd, block", ((near.CROWD, near.BLOCK), (6, 4)))
def test_near_copies_equal_brute_force(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(near, "CROWD", crowd)
    monkeypatch.setattr(near, "BLOCK", block)
    rows, at = [], 0
    for base in range(6):
        words = prose(base, 150).split()
        for k in range(8):
            copy = list(words)
            for i in range(k):
                copy[(i * 37) % 150] = f"new{base}{k}{i}"
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(at, rows[0][1]), (at + 1, rows[0][1])]
    found = {r.doc_id: (r.class_id, r.n_links) for r in near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingled(t) for i, t in rows}
    link = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            root[i] = min([root[i], *(root[j] for j in link[i])])
    assert found == {i: (root[i], len(link[i])) for i in sets}


def test_a_bucket_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    words = prose(3, 200).split()
    rows = [(i, " ".join(words[:190] + [f"x{i}"] + words[191:])) for i in range(40)]
    got = near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_levels_miss_less_than_the_recall_allows():
    assert near.missed() <= 1 - near.RECALL
    assert [near.trees(d) for d in near.LEVELS] == sorted(near.trees(d) for d in near.LEVELS)


def test_long_texts_do_not_agree_by_chance():
    texts = [" ".join(f"{v}{i}" for i in range(60_000)).encode() for v in "ab"]
    minima, _ = near.signatures(texts)
    assert (minima[0] == minima[1]).mean() < 0.03


def test_prefixes_are_longer_where_texts_crowd(spark, folder, monkeypatch):
    """Texts that share two thirds of their words but are no near copies get longer prefixes than
    texts that share nothing; copies of one text stay at the short ones."""
    monkeypatch.setattr(near, "CROWD", 20)
    monkeypatch.setattr(near, "BLOCK", 8)
    common = prose(31, 200).split()
    crowd = [" ".join(common + prose(1000 + i, 60).split()) for i in range(60)]
    alone = [" ".join(f"v{i}_{k}" for k in range(100)) for i in range(30)]
    pair = [alone[0] + " a", alone[0] + " b"]
    rows = [(i, t) for i, t in enumerate(crowd + alone + pair)]
    minima, _ = near.signatures([t.encode() for _, t in rows])
    nodes = spark.createDataFrame([(str(i), m.tobytes()) for (i, _), m in zip(rows, minima)], "copy string, minima binary")
    own = {}
    for r in near.levelled(nodes, folder).collect():
        assert r.level <= r.own
        own.setdefault(int(r.copy), set()).add(r.own)
    assert all(len(v) == 1 for v in own.values())
    assert sum(max(own.get(i, {2})) > 2 for i in range(60)) > 40 and {max(own[i]) for i in (90, 91)} == {2}
    got = {r.doc_id: r.n_links for r in near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingled(t) for i, t in rows}
    assert got == {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just above 0.8: every one of 300 is found."""
    rows = []
    for k in range(300):
        words = [f"p{k}_{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:84]))]
    assert len(shingled(rows[1][1])) / len(shingled(rows[0][1])) == 0.8
    got = near.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i, _ in rows}


def test_near_copies_of_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near.linked(odd).collect()), key=str)
    assert (3, 3, 0) in got and (4, 4, 0) in got and (8, 7, 1) in got and got.count((1, 1, 2)) == 2 and got.count((None, None, 1)) == 2
    assert near.linked(empty).count() == 0
    kept = Counter(r.doc_id for r in near.deduplicated(odd).collect())
    assert kept == {1: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1}
    assert near.deduplicated(odd).columns == odd.columns


# --- 3 decontamination ---------------------------------------------------------------


def test_planted_passages_are_found(spark, odd, empty):
    items = [(k, prose(100 + k, n)) for k, n in enumerate((15, 30, 57, 3))] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[2][1].split()
    edited[0] = "other"
    rows = [(1, prose(1, 40) + " " + items[0][1] + "\n" + prose(2, 9)), (2, items[1][1]), (3, prose(4, 90) + " " + " ".join(edited)), (4, prose(6, 300)), (5, "z " + items[3][1]), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()}
    assert found == {(1, 0), (2, 1), (3, 2), (5, 3), (None, 0)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [4]
    assert decontaminate.contaminations(odd, bench).count() == 0 and decontaminate.contaminations(empty, bench).count() == 0
    assert decontaminate.decontaminated(odd, bench.limit(0)).count() == odd.count()


def test_reordered_passages_equal_sql(spark):
    import duckdb

    a, b = prose(201, 30), prose(202, 30)
    third = [prose(210 + k, 19) for k in range(3)]
    items = [(1, f"{a} {b}"), (2, " ".join(third)), (3, "x y " * 20)]
    cut = f"{a} {b}".split()
    rows = [
        (1, f"{prose(203, 40)} {b} {a} {prose(204, 50)}"), (2, f"{b} {a}"), (3, f"{prose(205, 7)} {third[1]} {third[2]} {third[0]}"), (4, f"{a} {prose(206, 9)} {b}"),
        (5, f"{prose(207, 200)} {a} {b} {prose(208, 3)}"), (6, " ".join(cut[:20] + ["new"] + cut[21:])), (7, "y x " * 30), (8, prose(209, 300)),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, frame in (("documents", documents), ("benchmark", benchmark)):
        con.register(name, frame.toArrow())
    found = decontaminate.contaminations(documents, benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == sorted(con.sql(decontaminate.SQL).fetchall())
    # the two parts of item 1 share 52 of 56 shingles in the other order
    assert {(r.doc_id, r.item_id, r.start, r.similarity) for r in found if r.doc_id < 3} == {(1, 1, 40, 0.866667), (2, 1, 0, 0.866667)}


def test_no_fingerprint_within_the_radius_is_missed():
    wide, reach = decontaminate.BITS // decontaminate.BLOCKS, decontaminate.RADIUS // decontaminate.BLOCKS
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = rng.choice(64, decontaminate.RADIUS, replace=False)
        assert min(sum(b // wide == k for b in bits) for k in range(decontaminate.BLOCKS)) <= reach


# --- 4 outliers ----------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
    ls = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered)


def test_statistics_equal_brute_force(spark, odd):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        got = outliers.statistics(frame).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, got)) == Counter(brute_statistics(t) for _, t in texts_of(frame))


def test_outliers_are_rejected_and_others_kept(spark, odd, empty):
    rows = [(i, prose(i, 100 + i % 200), "en", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(i, 150).split()), "en", "a") for i in range(20)]
    got = outliers.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(1000, 1020))
    verdict = outliers.kept_rows(odd).collect()
    assert len(verdict) == odd.count() and all(r.kept is not None and r.kept != r.base_failed for r in verdict)
    assert outliers.kept_rows(empty).count() == 0


def test_small_groups_have_their_own_estimate(spark):
    starred = lambda i: " ".join(w + "***" for w in prose(i, 150).split())
    rows = [(i, prose(i, 100 + i), "en", "a") for i in range(60)] + [(100 + i, starred(i), "en", "a") for i in range(3)]
    rows += [(200 + i, starred(20 + i), "de", "b") for i in range(60)]
    rows += [(300 + i, prose(300 + i, 120 + i), "en", "c") for i in range(5)] + [(310, starred(90), "en", "c")]
    got = outliers.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == {100, 101, 102, 310}


def test_repeated_lines_alone_reject(spark):
    import random

    pick = random.Random(5)
    rows = [(i, prose(i, 100 + i % 200), "en", "a") for i in range(400)]
    for k in range(5):
        short = [pick.choice([f"w{j}" for j in range(15)]) for _ in range(85)]
        rows.append((1000 + k, "\n".join(short + [prose(500 + 20 * k + j, 8) for j in range(15)]), "en", "a"))
    got = outliers.kept_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if not r.kept} == set(range(1000, 1005))


# --- 5 language model ----------------------------------------------------------------


def brute_ppm(train, text, reach):
    counts = defaultdict(Counter)
    for s in train:
        for p in range(len(s)):
            for k in range(min(reach, p) + 1):
                counts[s[p - k : p]][s[p]] += 1
    total = 0.0
    for p in range(len(text)):
        out = set()
        for k in range(min(reach, p), -1, -1):
            left = {a: n for a, n in counts.get(text[p - k : p], {}).items() if a not in out}
            if not left:
                continue
            whole = len(left) + sum(left.values())
            if text[p] in left:
                total += math.log10(left[text[p]] / whole)
                break
            total += math.log10(len(left) / whole)
            out |= set(left)
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("common", [1 << 20, 4])
def test_scores_equal_brute_force(spark, odd, folder, monkeypatch, common):
    monkeypatch.setattr(ppm, "COMMON", common)
    train = [(i, prose(i, 60)) for i in range(5)] + [(None, "Zz ö"), (9, None)]
    rows = [r for r in texts_of(odd) if len(r[1] or "") < 5000] + [(70, prose(2, 60)), (71, "\x00 odd \x7f")]
    model = ppm.fit(spark.createDataFrame(train, "doc_id long, text string"), folder)
    got = ppm.scored(spark.createDataFrame(rows, "doc_id long, text string"), model, f"{folder}/scores").collect()
    low = lambda t: (t or "").encode().lower()
    seen = Counter(w for _, t in train for w in [*low(t).split(), "end"])
    whole, kinds = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        w = [*low(t).split(), "end"]
        base = sum(math.log10((seen[x] + 0.5) / (whole + 0.5 * (kinds + 1))) for x in w)
        want.append((str(i), len(w), sum(seen[x] > 0 for x in w), round(base, 6), round(brute_ppm([low(x) + b"\0" for _, x in train], low(t) + b"\0", ppm.ORDER), 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


@pytest.mark.parametrize("nodes", [0, 300])
def test_order_is_kept_beyond_the_held_nodes(spark, folder, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "NODES", nodes)
    train = [prose(i, 60) for i in range(5)] + ["Zz ö", None]
    texts = [prose(2, 60), prose(90, 80), "\x00 odd \x7f", "", None, "w1", "ünï w17 w17 cödé"]
    model = ppm.fit(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"), folder)
    got = ppm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, f"{folder}/scores").collect()
    low = lambda t: (t or "").encode().lower() + b"\0"
    assert {r.doc_id: r.score for r in got} == {i: pytest.approx(brute_ppm([low(x) for x in train], low(t), ppm.ORDER), abs=1e-6) for i, t in enumerate(texts)}


def test_nothing_learned_is_uniform(spark, empty, folder):
    model = ppm.fit(empty, folder)
    got = ppm.scored(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model, f"{folder}/scores").first()
    assert got.score == pytest.approx(-4 * math.log10(256)) and got.n_known == 0 and model["tokens"] == 0
    assert ppm.scored(empty, model, f"{folder}/none").count() == 0


# --- 6 token counts ------------------------------------------------------------------


def test_counts_after_edits_equal_a_new_count():
    import random

    whole = encoder().whole
    count = lambda t: len(whole.encode_ordinary(t))
    pick = random.Random(4)
    for text in (prose(1, 900), "", "a", "  \n\n x \n y ", "ünï " * 300, "x" * 3000, " " * 50 + "\n" * 700):
        tree = tokens.CountTree(text, count)
        for _ in range(40):
            a = pick.randrange(len(text) + 2)
            b = a + pick.choice([0, 0, 1, 30, 700])
            new = pick.choice(["", " ", "\n", "word", " two words ", " ", text[:600]])
            tree.edit(a, b, new)
            a, b = min(a, len(text)), min(max(a, b), len(text))
            text = text[:a] + new + text[b:]
            assert (tree.total, tree.length) == (count(text), len(text)) and "".join(tree.blocks) == text


def test_counts_of_odd_rows(spark, odd, empty):
    got = tokens.counted(odd.withColumn("edits", tokens.edits_of(F.col("text"), F.col("doc_id")))).collect()
    want = Counter((i, len(encoder().whole.encode_ordinary(t or ""))) for i, t in texts_of(odd))
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    long = [r for r in got if r.doc_id in (7, 8)]
    assert all(r.recoded_chars < 10_000 for r in long)
    assert tokens.counted(empty.withColumn("edits", tokens.edits_of(F.col("text"), F.col("doc_id")))).count() == 0


# --- 7 line spread -------------------------------------------------------------------


def test_lines_equal_brute_force(spark, odd, empty):
    rows = [(i, "\n".join([f"own {i}", "  on every site ", "", "on four" if i % 10 < 4 else f"not {i}", "on five" if i % 10 < 5 else "x" * i]), f"s{i % 10}") for i in range(40)]
    rows += [(100, "on every site", None), (101, None, "s1"), (None, "on five\nown", "s2"), (3, rows[3][1], "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spread = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip() and s is not None:
                spread[line.strip()].add(s)
    bad = {x for x, s in spread.items() if len(s) >= lines.SPREAD}
    want = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text) for r in lines.cleaned(docs).collect()) == want
    assert lines.cleaned(odd).count() == odd.count() and lines.cleaned(empty).count() == 0


# --- 8 quality -----------------------------------------------------------------------


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 512, 513, 992, 993, 5000):
        text = bytes(i % 251 + 1 for i in range(n))
        chunks = quality.chunked(text)
        joined = b"".join(bytes(c[: quality.STEP]) for c in chunks[:-1]) + bytes(chunks[-1])
        assert joined.rstrip(b"\0") == text


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (6, None)], "doc_id long, quality int")
    net = quality.learned(odd, labels)
    got = quality.scored(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(empty, quality.learned(empty, labels)).count() == 0


# --- 9 mixing ------------------------------------------------------------------------


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1 and own[0].target <= 2 * own[0].source_size
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mixed(empty).count() == 0 and mixing.selected(odd).columns == odd.columns


def test_selected_delivers_its_target_with_equal_rows(spark):
    """Words delivered stay within one document a source of the target, however many rows are equal."""
    rows = [(1, "w " * 20, "a", "x")] * 200 + [(None, f"{i} " * 10, "b", "x") for i in range(100)] + [(None, "same " * 10, "b", None)] * 100 + [(i, "t " * 7, "c", str(i % 3)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string").repartition(5)
    clashing = docs.withColumns({c: F.lit("x") for c in ("size_", "epoch_", "mark", "copies", "taken", "m_id_", "times", "key", "split")})
    goals = {r.source: r.target for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    got = mixing.selected(clashing)
    assert got.columns == clashing.columns and set(got.select("epoch_", "size_").collect()[0]) == {"x"}
    delivered = defaultdict(int)
    for r in got.collect():
        delivered[r.source] += len(WORD.findall(r.text))
    taken = {r.source: r.t for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    for source, goal in goals.items():
        assert taken[source] == int(goal) and goal <= delivered[source] + 1 and delivered[source] < goal + 20
    per_row = defaultdict(int)
    for r in got.collect():
        per_row[r.doc_id, r.text, r.source, r.note] += 1
    given = Counter(rows)
    assert all(n <= 2 * given[k] for k, n in per_row.items())


def test_rows_without_id_are_ordered_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(400)], "doc_id long, text string, source string")
    keys = mixing._units(docs, []).select("key").distinct().count()
    assert keys == 400 and sum(r.taken for r in mixing.mixed(docs).collect()) == int(800 * 1.5)


def test_sources_at_their_limit_share_the_rest(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 10 and sum(got.values()) == pytest.approx(1.5 * 1115)
    assert got["c"] == 200 and got["b"] == pytest.approx(1.5 * 1115 - 230)


# --- 10 training order ---------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 10, 257, 5000])
def test_every_slot_once(count):
    assert sorted(order.permuted(np.arange(count), count).tolist()) == list(range(count))


def test_shards_hold_every_sequence(spark, odd, empty, folder):
    odd.write.parquet(f"{folder}/in")
    docs = spark.read.parquet(f"{folder}/in")
    got = order.write_shards(docs, f"{folder}/out", length=64, per_shard=100).collect()
    back = list(order.read_slots(f"{folder}/out", 0, 10**9, per_shard=100))
    assert sorted(r.slot for r in got) == list(range(len(back)))
    want = Counter()
    for i, t in texts_of(odd):
        ids = [*encoder().whole.encode_ordinary(t or ""), END]
        want.update((i, p, tuple(ids[p * 64 : p * 64 + 64])) for p in range(-(-len(ids) // 64)))
    assert Counter((r.doc_id, r.part, tuple(back[r.slot][: r.n_tokens].tolist())) for r in got) == want
    assert all((back[r.slot][r.n_tokens :] == END).all() and zlib.crc32(back[r.slot][: r.n_tokens].tobytes()) == r.crc for r in got)
    resumed = list(order.read_slots(f"{folder}/out", 150, 120, per_shard=100))
    assert all((a == b).all() for a, b in zip(resumed, back[150:270])) and len(resumed) == 120
    assert order.write_shards(empty, f"{folder}/none").count() == 0
