"""Brute-force, round-trip and edge-case checks of the training-data operators."""

import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "re", "si", "tu") for b in ("n", "r", "st", "lm", "x", "vo", "qua")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def edit(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs = [(i, text(rng, rng.randrange(20, 120))) for i in range(60)]
    docs += [(100 + i, edit(rng, docs[i % 10][1], i % 4)) for i in range(40)]
    docs += [(200 + i, docs[0][1]) for i in range(5)]
    return docs + [(300, None), (301, ""), (302, "..."), (303, "ba do"), (304, "Ba  do!"), (None, "ba do"), (200, docs[0][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(t):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join_matches_brute_force(spark, corpus):
    from wattlake.llm.jaccard_join import jaccard_join

    rows = [r for r in corpus if r[0] is not None]
    sets = [(i, shingles(t)) for i, t in rows]
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = [sum(alike(s, o) for j, (_, o) in enumerate(sets) if j != k) for k, (_, s) in enumerate(sets)]
    root = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                if alike(sets[a][1], sets[b][1]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    group = {}
    for k, (i, _) in enumerate(sets):
        group[root[k]] = min(group.get(root[k], i), i)
    # Small buckets and blocks take every way: splits, families, slices, several blocks.
    for leaf, block in ((128, 512), (3, 4)):
        got = jaccard_join(frame(spark, corpus), leaf=leaf, block=block).collect()
        assert len(got) == len(corpus)
        want = Counter((i, group[root[k]], links[k]) for k, (i, _) in enumerate(sets))
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == want


def test_jaccard_join_links_copies_of_either_side_of_any_size(spark):
    from wattlake.llm.jaccard_join import jaccard_join

    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate((2044, 2064, 2051, 2052))] + [(9, " ".join(reversed(words[:2064])))]
    sizes = [len(shingles(t)) for _, t in rows]
    assert sizes == [2040, 2060, 2047, 2048, 2060]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(frame(spark, rows)).collect()}
    assert got == {**{i: (0, 3) for i in range(4)}, 9: (9, 0)}


def test_jaccard_join_tells_texts_of_one_id_apart(spark):
    from wattlake.llm.jaccard_join import jaccard_join, marked_join

    rng = random.Random(12)
    a, b, c = (text(rng, 60) for _ in range(3))
    for extra in ([], [(1, c)], [(1, text(rng, 50)) for _ in range(5)]):
        rows = [(1, a), (1, b), (5, edit(rng, b, 1)), (7, edit(rng, a, 1)), *extra]
        got = jaccard_join(frame(spark, rows).selectExpr("*", "map(1, 2) as mark", "0 as rep")).collect()
        assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == Counter([(1, 1, 1), (1, 1, 1), (5, 1, 1), (7, 1, 1), *[(1, 1, 0)] * len(extra)])
        groups = {}
        for r in marked_join(frame(spark, rows)).collect():
            groups.setdefault(r["group"], []).append(r["doc_id"])
        assert sorted(map(sorted, groups.values())) == sorted([[1, 5], [1, 7], *[[1]] * len(extra)])


def test_jaccard_join_around_long_texts(spark):
    """Against brute force, with texts of 1,700 to 2,600 words and near copies that are longer or edited."""
    from wattlake.llm.jaccard_join import jaccard_join

    rng = random.Random(14)
    rows = []
    for i, n in enumerate((1700, 1900, 2040, 2048, 2300, 2600)):
        t = text(rng, n)
        rows += [(10 * i, t), (10 * i + 1, t + " " + text(rng, 15)), (10 * i + 2, edit(rng, t, 20)), (10 * i + 3, edit(rng, t, 60)), (10 * i + 4, t + " " + text(rng, n // 5))]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(j != i and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in jaccard_join(frame(spark, rows)).collect()} == want and sum(want.values()) > 30


def test_jaccard_join_empty(spark):
    from wattlake.llm.jaccard_join import jaccard_join

    assert jaccard_join(frame(spark, [])).collect() == []


def test_components(spark):
    from wattlake.llm.shared import connected_components

    e = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (4, 1)] + [(20 + i, 21 + i) for i in range(15)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 5: 5, **{20 + i: 20 for i in range(16)}}


def test_substring_dedup_cuts_the_later_passage_only(spark):
    from wattlake.llm.substring_dedup import substring_dedup

    rng = random.Random(5)
    passage = text(rng, 80)
    rows = [(i, text(rng, 60)) for i in range(20)]
    rows += [(50, text(rng, 30) + " " + passage + " " + text(rng, 30)), (51, text(rng, 31) + "\n" + passage + " " + text(rng, 12)), (60, None), (61, ""), (None, "one two"), (50, None)]
    rows[-1] = rows[20]  # a repeated row
    rows += [(70, passage), (70, passage + " more")]
    assert sorted(str(r["text"]) for r in substring_dedup(frame(spark, rows)).collect() if r["doc_id"] in (50, 70)) == sorted([rows[20][1], rows[20][1], passage, passage + " more"])
    rows = rows[:-2]
    got = {r["doc_id"]: r for r in substring_dedup(frame(spark, rows)).collect()}
    for i, t in rows:
        if i != 51:
            assert got[i]["text"] == t
    # A row that is cut and stands three times is cut alike each time; other columns stay, maps too.
    from pyspark.sql import functions as F

    many = frame(spark, rows + [r for r in rows if r[0] == 51] * 2).selectExpr("*", "map('a', doc_id) as row", "'x' as words_removed", "1 as places")
    again = substring_dedup(many)
    assert again.columns == ["doc_id", "text", "row", "places", "words_removed", "spans_removed"]
    assert [(r["text"], r["words_removed"], r["row"]) for r in again.where(F.col("doc_id") == 51).collect()] == [(got[51]["text"], got[51]["words_removed"], {"a": 51})] * 3
    assert substring_dedup(frame(spark, [])).collect() == []
    cut = got[51]["text"].split()
    left = [w for w in passage.split() if w in cut]
    assert got[51]["words_removed"] >= 55 and len(cut) == 31 + 80 + 12 - got[51]["words_removed"] and left is not None


def test_substring_dedup_against_brute_force(spark):
    """Cut is what lies in runs of chunks that stand earlier, by chunks taken one by one; each cut span stands elsewhere before."""
    from wattlake.llm import textkit as tk
    from wattlake.llm.substring_dedup import chunk_bounds, substring_dedup

    rng = random.Random(11)
    shared = [text(rng, rng.randrange(10, 90)) for _ in range(6)]
    rows = [(i, " ".join(x for _ in range(4) for x in (text(rng, rng.randrange(5, 40)), rng.choice(shared)))) for i in range(40)]
    rows.append((99, text(rng, 20_000) + " " + shared[0] + " " + shared[0]))  # a very long text
    want, seen = {}, set()
    for i, t in rows:
        raw, off = tk.text_bytes(pa.array([t]))
        data, runs, run = raw.tobytes(), [], []
        for a, z in zip(*chunk_bounds(raw, off, 4, 8)[:2], strict=True):
            chunk = data[a:z].strip(b" \n")
            if chunk in seen:
                run.append((a, z, len(chunk.split())))
            else:
                seen.add(chunk)
                runs.append(run)
                run = []
        out, last = b"", 0
        for r in [*runs, run]:
            if sum(x[2] for x in r) >= 20:
                out, last = out + data[last : r[0][0]], r[-1][1]
        want[i] = (out + data[last:]).decode()
    got = {r["doc_id"]: r["text"] for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == want and sum(want[i] != t for i, t in rows) > 20


def test_chunks_tile_and_resist_shifts():
    from wattlake.llm import textkit as tk
    from wattlake.llm.substring_dedup import chunk_bounds

    t = text(random.Random(1), 3000)
    def pieces(*texts):
        raw, off = tk.text_bytes(pa.array(list(texts)))
        s, e, d = chunk_bounds(raw, off, 5, 12)
        data = raw.tobytes()
        out = [(k, data[a:b]) for a, b, k in zip(s, e, d, strict=True)]
        assert [b"".join(p for k, p in out if k == i) for i in range(len(texts))] == [x.encode() for x in texts]
        return [p for k, p in out if k == len(texts) - 1]

    plain = pieces(t)
    assert pieces("x y", "", t) == plain  # texts before do not matter
    for seed in range(40):  # nor do hits in their last words, after which no white space stands
        before = text(random.Random(seed), 12) + " " + "".join(text(random.Random(seed + 99), 9).split())
        assert pieces(before, t) == plain
    assert len(set(pieces("inserted " + t)) & set(plain)) >= len(set(plain)) - 2


def test_contamination(spark):
    from wattlake.llm.decontaminate import contamination, smith_waterman

    rng = random.Random(9)
    items = [(i, text(rng, 30)) for i in range(6)] + [(7, None), (8, "ba do"), (None, text(rng, 9))]
    docs = [(i, text(rng, 90)) for i in range(30)]
    docs += [(100, text(rng, 20) + " " + items[2][1].upper() + " " + text(rng, 20)), (101, edit(rng, items[3][1], 5)), (102, None), (103, ""), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (10_000, 0):  # seeds in memory, and the shuffled join
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(frame(spark, docs), bench, seeds_in_memory=bound).collect()}
        assert set(got) == {(100, 2), (101, 3)} and got[100, 2] == 1.0 and 0.5 <= got[101, 3] < 1

    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    r = np.random.default_rng(0)
    a, b = r.integers(2, 6, (20, 9)).astype(np.uint64), r.integers(2, 6, (20, 15)).astype(np.uint64)
    assert smith_waterman(a, b)[0].tolist() == [slow(x, y) for x, y in zip(a, b, strict=True)]


def test_contamination_finds_edited_copies_beside_exact_ones(spark):
    from wattlake.llm.decontaminate import contamination

    words = [f"w{i}" for i in range(40)]
    edited = [f"x{i}" if i % 3 == 0 and i < 30 else w for i, w in enumerate(words)]  # ten words: the last seeds stay
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, "other words that stand in no item")]
    for bound in (10_000, 0):
        got = {r["doc_id"]: r["score"] for r in contamination(frame(spark, docs), bench, seeds_in_memory=bound).collect()}
        assert set(got) == {1, 2} and got[1] == 1.0 and 0.5 <= got[2] < 1


def test_contamination_recalls_uniformly_edited_copies(spark):
    """Against brute-force alignment of every item with every document, at edit rates up to 40 %."""
    from wattlake.llm.decontaminate import contamination

    rng = random.Random(21)
    items = [(i, text(rng, rng.randrange(20, 50))) for i in range(20)]
    docs, n = [(i, text(rng, 80)) for i in range(20)], 100
    for i, t in items:
        for rate in (0.05, 0.1, 0.2, 0.3, 0.4):
            w = [f"zz{rng.randrange(10**6)}" if rng.random() < rate else x for x in t.split()]
            docs.append((n, text(rng, 15) + " " + " ".join(w) + " " + text(rng, 15)))
            n += 1

    def best(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        top = 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                top = max(top, h[i + 1][j + 1])
        return top / (2 * len(a))

    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = {(d, i): best(plain(t), plain(x)) for d, x in docs for i, t in items if d < 100 or (d - 100) // 5 == i}
    want = {k: v for k, v in want.items() if v >= 0.5}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and len(set(got) & set(want)) >= 0.9 * len(want) and all(got[k] <= want[k] + 1e-6 for k in got if k in want) and all(d >= 100 for d, _ in got)


def test_contamination_finds_short_items_and_other_scripts(spark):
    from wattlake.llm.decontaminate import contamination

    items = [(1, "Brown fox?"), (2, "one two three four"), (3, "Привет мир как дела сегодня друг"), (4, None), (5, "..."), (6, "漢字仮名交じり文"), (7, "fox")]
    docs = [(1, "the brown fox jumps, BROWN FOX"), (2, "One, two “three”—four"), (3, "ПРИВЕТ МИР, КАК ДЕЛА СЕГОДНЯ ДРУГ"), (4, None), (5, ""), (6, "これは漢字仮名交じり文です"), (None, "brown fox")]
    found = contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (1, 7), (2, 2), (3, 3), (6, 6)} and all(r["score"] == 1.0 for r in found)
    empty = frame(spark, [])
    assert contamination(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == [] and contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_language(spark):
    from wattlake.llm.language_id import identify, train

    rng = random.Random(2)
    kinds = {"aa": "the and ing th er on ly".split(), "bb": "der und ung ein sch lich zu".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(kinds[k]) for _ in range(30)), k) for i in range(80) for k in kinds]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(d.where("doc_id < 60"))
    extra = spark.createDataFrame([(900, None, "aa"), (901, "12 !!", None)], d.schema)
    got = identify(d.where("doc_id >= 60").union(extra).selectExpr("*", "1 as lang_pred"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["lang_score"] <= 1 for r in got if r["doc_id"] < 900)
    assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] >= 900)
    assert (model.weights == 0).mean() > 0.5
    assert [r["lang_pred"] for r in identify(extra, train(d.limit(0))).collect()] == ["und", "und"]


def test_zip_reader_reads_plain_and_zip64():
    from wattlake.llm.warc import member_range, zip_members, zip_stored

    for wide in (False, True):
        data = zip_stored([("a/b.txt", b"hello"), ("c", b"")], b"note", zip64=wide)
        assert zipfile.ZipFile(BytesIO(data)).read("a/b.txt") == b"hello"
        read = lambda at, n: data[at : at + n]  # noqa: B023, E731
        found = zip_members(read, len(data))
        at, n = member_range(read, found["a/b.txt"])
        assert data[at : at + n] == b"hello" and set(found) == {"a/b.txt", "c"}
    packed = BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"y" * 99)
    raw = packed.getvalue()
    with pytest.raises(ValueError):
        member_range(lambda a, n: raw[a : a + n], zip_members(lambda a, n: raw[a : a + n], len(raw))["x"])


def test_warc_round_trip(spark, tmp_path):
    from wattlake.llm.warc import read_archives, write_archives

    big = "é<p>" * 400
    rows = [(1, "http://a/b c\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (9, "u", big), (9, "u", big), (None, "u", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    for k, bound in enumerate((100, 0)):
        path = f"file://{tmp_path}/{k}"
        write_archives(d, path, target_bytes=3000, repeats_in_memory=bound)
        got = read_archives(spark, path).collect()
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=key) == [(1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (9, "response", None), (9, "response", None), (None, "response", None)]
        want = {i: (h or "").encode() for i, _, h in rows}
        for r in got:
            assert r["payload_digest"] == hashlib.sha1(want[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(want[r["page_id"]])
            assert r["payload"] is None or bytes(r["payload"]) == want[r["page_id"]]


def test_quality_model_learns_single_and_pair_effects():
    from wattlake.llm.quality import features, fit

    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.3) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    m = fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) >= 0.5) == (y[2000:] > 0)).mean() > 0.93
    assert fit(x[:0], y[:0]).predict(x[:2]).shape == (2,) and fit(x[:9], np.ones(9)).predict(x[:1])[0] > 0.9
    assert not features(pa.array([None, ""])).any()


def test_nearest_matches_brute_force(spark):
    from pyspark.sql import functions as F

    from wattlake.llm.ann import nearest

    r = np.random.default_rng(4)
    x = r.standard_normal((400, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1050, x[0].tolist()), (1051, x[0].tolist()), (1100, [1.0, 2.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, query_block=3, data_block=50).collect()
    ids = np.array([i for i, v in rows[:400]] + [1050, 1051])
    y = np.concatenate([x, x[:1], x[:1]]).astype(float)
    hit = 0
    for q in [i for i in ids if i % 50 == 0]:
        k = list(ids).index(q)
        s = (y * y[k]).sum(1) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[k])
        s[k] = -9
        want = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12)))[:5]]
        mine = [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])]
        hit += len(set(want) & set(mine))
        assert len(mine) == 5
    assert hit >= 0.95 * 5 * 9 and all(g["query_id"] != 1100 for g in got)


def test_frequent_words_do_not_hang_on_how_texts_lie_in_tasks(spark):
    """A word that most tasks leave out, and one that they name, count in full: by exact counts over all tasks."""
    from pyspark.sql import functions as F

    from wattlake.llm import lm_score as L

    texts = ["rare " + "often " * 30 + " ".join(f"w{i}x{j}" for j in range(69)) for i in range(40)] + ["rare " * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {}
    for tasks in (1, 8, 41):
        dealt = docs.repartition(tasks, "id").select("text")
        some = L.candidate_words(dealt, 2.0, 0.05)
        # The least is 139 of 4341 tokens; 300 of "rare" are in one text.
        bare = spark.sparkContext.broadcast(some.words)
        cells = dealt.mapInArrow(L._count(bare), L.CELLS_SCHEMA).repartition("key").sortWithinPartitions("key").mapInArrow(L._merge, L.CELLS_SCHEMA)
        got[tasks] = L.settle(cells, some)
        some.least = 335  # of 340: only the tasks that leave it out make it up
        some.lack[:] = 1
        assert len(L.settle(cells, some).key) == 2
    assert all(len(f.key) == 2 and (f.key == got[1].key).all() for f in got.values())


def test_tasks_name_few_words_however_texts_are_dealt(spark, monkeypatch):
    """A task of few tokens does not name its whole vocabulary as frequent words, and none that is frequent is lost."""
    from wattlake.llm import lm_score as L

    texts = [" ".join([*[f"c{k}" for k in range(10)] * 10, *[f"t{i % 20}"] * 36, *[f"w{i}x{j}" for j in range(500)]]) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    shares, heavy = [], L._heavy
    monkeypatch.setattr(L, "_heavy", lambda share: shares.append(share) or heavy(share))
    counts = Counter(w for t in texts for w in t.split())
    tokens = sum(counts.values()) + len(texts)
    for per_root, want in ((4.0, 10), (18.0, 30)):
        assert want == sum(n >= tokens / (int(per_root * tokens ** (1 / 3)) + 1) for n in counts.values())
        for tasks in (1, 40):
            dealt = docs.repartitionByRange(tasks, "id").select("text")
            some = L.candidate_words(dealt, per_root)
            cells = dealt.mapInArrow(L._count(spark.sparkContext.broadcast(some.words)), L.CELLS_SCHEMA).repartition("key").sortWithinPartitions("key").mapInArrow(L._merge, L.CELLS_SCHEMA)
            assert len(L.settle(cells, some).key) == want
    assert docs.repartitionByRange(40, "id").select("text").mapInArrow(heavy(shares[1]), "key long, cls long, n long, cut long").count() <= 40 * 12


def test_few_pairs_leave_a_block_however_many_reach_the_floor():
    """Vectors of one direction all have the same cosine: the smaller ids leave the block, not all pairs."""
    import pyarrow as pa

    from wattlake.llm.ann import _best, encode

    x = np.concatenate([np.outer(np.arange(1, 301), np.ones(16)), np.random.default_rng(2).standard_normal((300, 16))])
    codes, correction = encode(x)
    vectors = pa.array(x.tolist(), pa.list_(pa.float64()))
    data = pa.table({"gid": pa.array(range(600)), "v": vectors, "code": pa.array([c.tobytes() for c in codes], pa.binary()), "correction": pa.array(correction)})
    queries = data.select(["gid", "v"]).take([0, 7, 450])
    got = _best(6, 3.5)(queries, data).to_pylist()
    assert len(got) == 18
    for q in (0, 7):
        assert [r["gid"] for r in got if r["query_gid"] == q] == [0, 1, 2, 3, 4, 5]
    own = x @ x[450] / np.linalg.norm(x, axis=1)
    assert {r["gid"] for r in got if r["query_gid"] == 450 and r["score"] > own.max() / np.linalg.norm(x[450]) - 1e-9} == {450}


def test_nearest_with_extreme_components_and_hot_vectors(spark):
    from pyspark.sql import functions as F

    from wattlake.llm.ann import nearest

    rows = [(50, [1e200, 1.0]), (1, [1e190, 0.0]), (2, [0.0, 1e-300]), (3, [1e-310, 1e-310]), (4, [-1e300, 1e300])] + [(i, [3.0, 4.0]) for i in range(100, 400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest(d, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got[50] == [(1, 1.0), (3, round(0.5**0.5, 9)), (100, 0.6), (101, 0.6), (102, 0.6)]
    assert got[100] == [(i, 1.0) for i in (101, 102, 103, 104, 105)] and got[350] == [(i, 1.0) for i in (100, 101, 102, 103, 104)]
    assert set(got) == {50, 100, 150, 200, 250, 300, 350} and nearest(d.limit(0), F.lit(True)).collect() == []


def test_first_fit_decreasing_matches_plain():
    from wattlake.llm.packing import first_fit_decreasing

    x = np.sort(np.random.default_rng(1).integers(1, 100, 300))[::-1]
    free, want = [], []
    for n in x:
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        if k == len(free):
            free.append(100)
        want.append((k, 100 - free[k]))
        free[k] -= n
    bins, off = first_fit_decreasing(x, 100)
    assert list(zip(bins.tolist(), off.tolist(), strict=True)) == want


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    from wattlake.llm.packing import pack_documents
    from wattlake.llm.queries import tokenizer_path

    rng = random.Random(8)
    rows = [*corpus, (400, text(rng, 9000)), (401, "It's <|endoftext|> É–ñ, isn't IT?")]
    got = pack_documents(frame(spark, rows), tokenizer_path(), size=512, group=20).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 512):
            part = np.array(ids[a : a + 512], "<u4")
            want[i, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 512


def test_lm_scores(spark, corpus):
    from pyspark.sql import functions as F

    from wattlake.llm.lm_score import score_documents

    rows = [r for r in corpus if r[0] is not None]
    got = score_documents(frame(spark, corpus), F.col("doc_id") % 5 == 1, block_bytes=9000).collect()
    assert len(got) == len(corpus)
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "\n"]
    c = Counter(w for i, t in rows if i % 5 != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        w = tok(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert -12 * len(w) < r["score"] < 0
    empty = score_documents(frame(spark, [(1, None)]), F.lit(True)).collect()
    assert len(empty) == 1 and empty[0]["train_tokens"] == 0 and score_documents(frame(spark, []), F.lit(False)).collect() == []


def test_lm_probabilities_sum_to_one_where_texts_are_scored(spark, monkeypatch):
    """On the path that scores texts, in every context, but for the step in which probabilities travel."""
    from pyspark.sql import functions as F

    from wattlake.llm import lm_score as L

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[: 3 + 2 * (i % 30)]) for _ in range(40))) for i in range(150)]
    seen = {}
    real_score, real_model = L._score, L._model
    monkeypatch.setattr(L, "_score", lambda samples, frequent: seen.update(samples=samples, frequent=frequent.value) or real_score(samples, frequent))
    monkeypatch.setattr(L, "_model", lambda frequent, *a: seen.update(model=real_model(frequent, *a)) or seen["model"])

    class Kept(L.Scratch):
        def write(self, df, name):
            seen[name] = super().write(df, name)
            return seen[name]

    L.score_documents(frame(spark, rows), F.col("doc_id") < 0, per_root=3.0, scratch=Kept(spark)).collect()
    model = seen["cells"].mapInArrow(seen["model"], "key long, model binary").toArrow()
    look, scorer = L.Lookup(model["model"].combine_chunks(), 2), L.Scorer(seen["samples"], seen["frequent"])
    frequent, rows = len(seen["frequent"].key), np.arange(len(model))
    assert 10 < frequent < len(rows)
    for ctx in range(L.CLASSES + frequent):
        assert scorer.probability(look, rows, np.full(len(rows), ctx)).sum() + scorer.unknown[ctx] == pytest.approx(1, abs=4e-4)


def test_lm_gains_on_held_out_texts_with_more_contexts(spark):
    from pyspark.sql import functions as F

    from wattlake.llm.language_id import fold_of
    from wattlake.llm.lm_score import score_documents

    docs, held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fold_of(F.col("doc_id"), 5) == 1
    sums = []
    for per_root in (4.0, 900.0):  # the default, and every word a context
        got = score_documents(docs, held, per_root=per_root).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
        sums.append((got[1] - got[0]) / got[2])
    assert sums[0] > 0.2 and sums[1] > sums[0] + 0.1


def test_lm_blocks_hold_bounded_text_whatever_the_ids(spark):
    from pyspark.sql import functions as F

    from wattlake.llm.lm_score import _blocked
    from wattlake.llm.shared import Scratch

    ids = [*range(3000), 10**12, -(10**15), *[None] * 50, *[7] * 2000]
    d = spark.createDataFrame([(i, f"{k:100}") for k, i in enumerate(ids)], "doc_id long, text string")
    sizes = [r["count"] for r in _blocked(d, 10_000, Scratch(spark)).groupBy("block").agg(F.count("*").alias("count")).collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 250 and len(sizes) > 30


def test_html(spark):
    from wattlake.llm.html_extract import Page, extract

    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class="cookie-banner">Accept</div><article><h1>Head &amp; more</h1><p><b>One\n  two.<br><p>Three <i>four</i>&nbsp;five<!-- no --><script>var t="</p>";</script><div class="comments"><p>first!</div><ul><li>a<li>b</ul></article><footer>end</footer></body></html>'
    assert Page(page).main_text(frozenset()) == "Head & more\nOne two.\nThree four five\na\nb"
    assert Page("").main_text(frozenset()) == "" and Page("plain < text").main_text(frozenset()) == "plain < text"
    kept = '<article><p class="comment-free">One.</p><section class="related work"><p>Two.</p></section><p>Let <math><mi>x</mi></math> be</p><div class="ad-slot">Buy</div><ul class="share-buttons"><li>Post</ul></article>'
    assert Page(kept).main_text(frozenset()) == "One.\nTwo.\nLet x be"
    # Two layouts on 40 % of a host's pages each; in an article a paragraph of four pages is no template, though elsewhere it is.
    layout = lambda i: f"<body><div><p>Layout {i % 2} says this.</p></div><div><p>Own text {i}.</p></div></body>" if i % 5 < 4 else f"<body><p>Plain {i}.</p></body>"
    several = [(i, f"http://two.example/{i}", layout(i)) for i in range(20)] + [(100 + i, f"http://quotes.example/{i}", f"<article><p>A quotation.</p><p>Text {i}.</p></article>") for i in range(5)] + [(200 + i, None, f"<p>No host.</p><p>Text {i}.</p>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(several, "page_id long, url string, html string")).collect()}
    assert got[0] == "Own text 0." and got[3] == "Own text 3." and got[4] == "Plain 4." and got[102] == "A quotation.\nText 2." and got[205] == "No host.\nText 5."
    body = lambda i: f"<body><div><p>Every page says this.</p></div><div><p>Text {i} alone {i * 7}.</p></div></body>"
    rows = [(i, f"http://h.example/{i}", body(i)) for i in range(12)] + [(50, "http://other/1", body(1)), (60, None, None), (61, "::bad::[", "")]
    for bound in (1000, 0):
        got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string"), templates_in_memory=bound).collect()}
        assert got[3]["text"] == "Text 3 alone 21." and got[50]["text"].startswith("Every page") and got[60]["text"] == got[61]["text"] == ""
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_pipeline_small(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "decontaminate", "packing"]


def test_pipeline_keeps_rows_without_or_with_reused_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    a, b, c, d, e = (text(rng, 80) for _ in range(5))
    rows = [(5, a), (7, edit(rng, a, 1)), (7, b), (7, b), (8, c), (8, d), (3, c), (None, e), (None, text(rng, 60)), (20, None), (20, None), (21, ""), (21, "...")]
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter([(5, a), (7, b), (8, d), (3, c), *rows[7:9], (20, None), (21, ""), (21, "...")])
    spark.createDataFrame([(1, b), (2, e)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()
    assert Counter(map(tuple, left)) == Counter(r for r in rows if r[1] not in (b, e))


def test_pipeline_stages_with_clashing_columns_long_texts_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    passage, long = text(rng, 80), text(rng, 30_000)
    rows = [(1, text(rng, 40) + " " + passage), (2, text(rng, 50) + " " + passage + " " + text(rng, 30)), (3, passage), (4, None), (5, ""), (6, long), (7, long), (None, "ba do")]
    docs = frame(spark, rows).selectExpr("*", "'aa' as lang", "cast(length(text) as long) as n_chars", "map('k', doc_id) as row", "doc_id as cut_text", "1 as _row", "2 as k1", "array(1) as words_removed")
    spark.createDataFrame([(1, text(rng, 20)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"language": {1, 2, 3, 6, 7, None}, "near_duplicates": {1, 2, 3, 4, 5, 6, None}, "repeated_passages": {1, 2, 4, 5, 6, None}, "decontaminate": {1, 2, 3, 4, 5, 6, 7, None}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        ids = {r["doc_id"] for r in got}
        if name == "repeated_passages":  # edges of a passage may stay, and what is left of 3 or 7
            ids -= {3, 7}
            by = {r["doc_id"]: r for r in got}
            assert by[1]["text"] == rows[0][1] and len(by[2]["text"].split()) < 110 and by[2]["n_chars"] == len(by[2]["text"])
            assert all(len(by[i]["text"].split()) < 20 for i in (3, 7) if i in by)
        assert ids == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    packed = corpus_pipeline.packing(spark, docs, "")
    assert {r["doc_id"] for r in packed.collect()} == {1, 2, 3, 4, 5, 6, 7, None} and corpus_pipeline.packing(spark, docs.limit(0), "").collect() == []


def test_pipeline_against_brute_force(spark, tmp_path):
    """Kept rows and texts of a small corpus whose copies, leaks and passages are known."""
    import corpus_pipeline

    rng = random.Random(18)
    items = [(i, text(rng, 30)) for i in range(3)]
    base = [text(rng, rng.randrange(60, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edit(rng, base[i], 1)) for i in range(6)] + [(200, base[7]), (300, text(rng, 20) + " " + items[1][1] + " " + text(rng, 20)), (400, "12 34"), (401, "")]
    frame(spark, rows).selectExpr("*", "'aa' as lang", "'s' as source", "cast(length(text) as long) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    everything = {i for i, _ in rows}
    copies = {i for k, (i, t) in enumerate(rows) for j, u in rows[:k] if shingles(t) and len(shingles(t) & shingles(u)) >= 0.8 * len(shingles(t) | shingles(u))}
    assert seen["language"] == everything - {400, 401} and seen["near_duplicates"] == seen["language"] - copies and copies >= {200}
    assert seen["repeated_passages"] == seen["near_duplicates"] and seen["decontaminate"] == seen["near_duplicates"] - {300} and seen["packing"] == seen["decontaminate"]
