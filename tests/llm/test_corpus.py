"""Operators of the corpus subpackage against brute force, round trips and held-out accuracy."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, decontam, jaccard, langid, licenses, neardup, packing, pii, quality, sharding, textscan, tokencount
from sparkloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, piece string, node long, n int"
ODD = [None, "", " ", "one", "two words", "a b c d e", "\t\n", "it's a test", "ünïcode wörds ärе мир 世界", "x" * 5000]


def frame(spark, texts, ids=None, langs=None):
    """Documents with further columns whose names clash with those that operators use."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, (langs or {}).get(i), None, None, "p", 7, 1) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- word scanning ---


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, n).encode() for n in (0, 1, 5, 300, 1000)] + [b"", b"a" * 400, b"  x  "]
    whole = textscan.word_hashes(texts)
    monkeypatch.setattr(textscan, "WINDOW", 64)
    small = textscan.word_hashes(texts)
    assert whole[1].tolist() == small[1].tolist()
    assert whole[0].tolist() == small[0].tolist()


MORSE = "".join("ab"[i.bit_count() & 1] for i in range(1024))
OTHER_MORSE = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 64, 128, 256, 512, 1024])
def test_words_that_cancel_in_polynomial_sums_have_hashes_of_their_own(size):
    """Thue-Morse words and their complements collide in every sum over powers modulo 2**64."""
    for seed in (0, 1):
        data = np.frombuffer(f"{MORSE[:size]} {OTHER_MORSE[:size]} {MORSE[:size]}".encode(), np.uint8)
        starts = np.array([0, size + 1, 2 * size + 2])
        one, two, again = textscan.span_hashes(data, starts, starts + size, seed).tolist()
        assert one == again != two


def test_word_hashes_against_the_words_themselves():
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choice("abAB\0é") for _ in range(rng.choice((1, 2, 7, 8, 9, 16, 17, 255, 256, 257)))) for _ in range(60)) for _ in range(9)]
    hashes, at = textscan.word_hashes([t.encode() for t in texts])
    plain = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())]
    assert len(plain) == len(hashes) == at[-1]
    assert len(set(zip(plain, hashes.tolist(), strict=True))) == len(set(plain)) == len(set(hashes.tolist()))


def test_words_beside_a_run_beyond_a_window_keep_their_hashes():
    near = "one two three four five six"
    run = "0f" * (textscan.WINDOW // 2 + 40)
    plain, at = textscan.word_hashes([near.encode()])
    for text in (f"{run} {near}", f"{near} {run} {near}", f"{run} {run[:-2]} {near}"):
        got, _ = textscan.word_hashes([text.encode()])
        assert got[-6:].tolist() == plain.tolist()
    both, one = (textscan.shingle_sets([t.encode()])[0] for t in (f"{near} {run} {near}", near))
    assert len(both) == 7 and np.isin(one, both).all()  # 9 runs, of which the last two repeat the first two


def test_a_passage_behind_a_run_beyond_a_window_is_caught(spark):
    rng = random.Random(18)
    item = words(rng, 40, 5000)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs = frame(spark, ["0f" * (textscan.WINDOW // 2 + 40) + " " + item, "0f" * 50])
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect() if r["contaminated"]] == [0]


def test_shingle_sets_count_distinct_runs():
    rng = random.Random(2)
    texts = [words(rng, n, 5) for n in (0, 1, 4, 5, 6, 50)]
    got = [len(s) for s in textscan.shingle_sets([t.encode() for t in texts])]
    want = []
    for t in texts:
        w = t.split()
        want.append(len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
    assert got == want


# --- components ---


@pytest.mark.parametrize("local", [0, 1000])
def test_components_against_union_find(spark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


# --- 1 sharding ---


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    m, n = rng.randint(1, 6), rng.randint(1, 6)
    supply = [rng.randrange(50) for _ in range(m)]
    caps = sharding.even_capacities(sum(supply), n)
    flow = sharding.min_cost_flow(supply, caps, sharding.move_cost(m, n))
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow, strict=True)] == caps
    moved = sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j)
    assert moved == sum(supply) - sum(min(s, c) for s, c in zip(supply, caps, strict=False))


def test_flow_with_general_costs_against_all_assignments():
    cost = [[4, 1, 3], [2, 0, 5], [3, 2, 2]]
    flow = sharding.min_cost_flow([1, 1, 1], [1, 1, 1], cost)
    got = sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3))
    assert got == min(sum(cost[i][p[i]] for i in range(3)) for p in itertools.permutations(range(3)))


def test_reshard_places_every_row_once(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(40)) for _ in range(300)] + ODD + ["same", "same"]
    ids = [*range(len(texts) - 2), 900, 900]
    docs = frame(spark, texts, ids)
    rows = sharding.reshard(docs, F.when(F.col("doc_id") < 200, 0).otherwise(F.col("doc_id") % 3), 3, shards=4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(by) == 4 and max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    text = dict(zip(ids, texts, strict=True))
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 for r in rows)
    assert sharding.reshard(docs.limit(0), F.lit(0), 3, shards=4).count() == 0


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 9, 0 if i < 10 else 1 if i < 16 else 2) for i in range(20)], "doc_id long, text string, old_shard int")
    touched, others = sharding.rewrite(docs, F.col("old_shard"), 3, str(tmp_path / "a"), capacities=[100, 60, 40])
    assert touched == [] and others.count() == 20
    for _ in range(2):  # again: the same shards are replaced, not added to
        touched, others = sharding.rewrite(docs, F.col("old_shard"), 3, str(tmp_path / "b"), capacities=[80, 80, 40])
        assert touched == [0, 1] and {r["shard"] for r in others.collect()} == {2}
        assert spark.read.parquet(str(tmp_path / "b")).count() == 16


@pytest.mark.parametrize("small", [500, 2])
def test_rewrite_writes_null_and_repeated_ids_once(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(sharding, "SMALL_ROWS", small)
    monkeypatch.setattr(sharding, "LEAST_BLOCKS", 4)
    ids = [None, None, None, 3, 3, 3, 4, 4, *range(10, 40)]
    texts = ["a", "a", None, "b", "b", "other", "", None, *("x" * (i % 5) for i in range(30))]
    docs = spark.createDataFrame([(i, t, [0, 2, None][k % 3], k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, old_shard int, slot int").withColumn("row", F.col("slot"))
    touched, others = sharding.rewrite(docs, F.col("old_shard"), 3, str(tmp_path / "a"), shards=4)
    assert touched == [0, 1, 2, 3] and others.count() == 0
    got = spark.read.parquet(str(tmp_path / "a")).collect()
    assert sorted(r["row"] for r in got) == list(range(len(ids)))
    assert all((r["doc_id"], r["text"]) == (ids[r["row"]], texts[r["row"]]) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(len(r["text"] or "") + 1 for r in v) for v in by.values()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 6
    stays = spark.createDataFrame([(None, "same", i % 3, i) for i in range(12)], "doc_id long, text string, old_shard int, row int")
    touched, others = sharding.rewrite(stays, F.col("old_shard"), 3, str(tmp_path / "b"), capacities=[30, 10, 20])
    got = spark.read.parquet(str(tmp_path / "b")).collect()
    assert sorted(r["row"] for r in got) == [i for i in range(12) if i % 3 in touched]
    assert sorted(r["row"] for r in others.collect()) == [i for i in range(12) if i % 3 not in touched]


def test_rows_that_are_all_equal_go_to_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL_ROWS", 4)
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = sharding.reshard(docs, F.lit(1), 2, shards=5).collect()
    by = Counter(r["shard"] for r in rows)
    assert sorted(by.values()) == [600] * 5 and len({(r["shard"], r["slot"]) for r in rows}) == 3000


def test_op1_keeps_its_law(spark):
    sf = "/root/testdata/sf0.001"
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = sharding.op1(spark, sf).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


# --- 2 n-gram Jaccard join ---


def brute_components(texts, k=5):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root[a], root[b]
            for i in root:
                if root[i] == max(ra, rb):
                    root[i] = min(ra, rb)
    return {i: (len(sets[i]), root[i]) for i in texts}


def near_copies(rng, n=120):
    base = [words(rng, rng.randrange(6, 60)) for _ in range(12)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "hot", "block"), [(5, 400_000, 1024), (6, 3, 4)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(random.Random(seed)) + ODD + ["A B  c d E", "one"]
    want = brute_components(dict(enumerate(texts)))
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(frame(spark, texts)).collect()}
    assert got == want


def test_jaccard_join_of_repeated_and_null_ids_and_nothing(spark):
    docs = frame(spark, ["a b c d e f g", "a b c d e f g", "a b c d e f g", None], [4, 4, None, None])
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard_join(docs).collect()), key=str)
    assert rows == [(4, 3, 4), (4, 3, 4), (None, 0, None), (None, 3, 4)]
    assert jaccard.ngram_jaccard_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "rare"), [(1024, 6), (4, 1), (7, 50)])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block, rare):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "RARE", rare)
    rng = random.Random(17)
    base = [f"v{i}" for i in range(80)]
    group = [" ".join([*base[:p], f"x{p}", *base[p + 1 :]]) for p in rng.sample(range(80), 40)]
    texts = [*near_copies(rng, 60), *group, group[0], group[0], *ODD, "one"]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for t in texts)]
    want = [sum(i != j and bool(x) and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    assert sum(want) > 1000
    ids = [i if i % 7 else None for i in range(len(texts))]
    got = jaccard.ngram_jaccard_join(frame(spark, texts, ids)).collect()
    assert {r["doc_id"]: r["n_links"] for r in got if r["doc_id"] is not None} == {i: want[i] for i in ids if i is not None}
    assert sorted(r["n_links"] for r in got) == sorted(want)


def test_link_counts_against_sql(spark):
    import duckdb

    from sparkloom.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.QUERIES["op2_ngram_jaccard_links"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["op2_ngram_jaccard_links"]).fetchall())


def test_bitmap_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(7)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = np.unique(rng.choice(pool, 40)), np.unique(rng.choice(pool, 15))
        bits = 64 * min(jaccard.bitmap_bits(len(a)), jaccard.bitmap_bits(len(b))) // 64
        x, y = (jaccard.fold(jaccard.bitmap(s, jaccard.bitmap_bits(len(s))), bits) for s in (a, b))
        assert jaccard.overlap_bound(x, len(a), y, len(b)) >= len(np.intersect1d(a, b))


# --- 3 decontamination ---


def slow_tiles(item, doc, least):
    """Greedy string tiling as it is defined, by comparing everything with everything."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n > best[2]:
                    best = (i, d, n)
        if best[2] < least:
            return tiles
        tiles.append(best)
        used_i |= set(range(best[0], best[0] + best[2]))
        used_d |= set(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("seed", range(25))
def test_tiling_against_the_definition(seed):
    rng = np.random.default_rng(seed)
    item, doc = rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64)
    got = decontam.tile(item, doc, 2)
    assert sorted(t[2] for t in got) == sorted(t[2] for t in slow_tiles(item.tolist(), doc.tolist(), 2))
    assert all((item[i : i + n] == doc[d : d + n]).all() for i, d, n in got)


def test_reordered_passages_are_caught_and_clean_texts_are_not(spark, monkeypatch):
    rng = random.Random(8)
    items = [words(rng, 40, 5000) for _ in range(6)]
    w = items[2].split()
    shuffled = " ".join([*w[20:40], "noise", *w[10:20], "more", *w[:10]]).upper().replace(" ", ", ")
    texts = [words(rng, 200, 5000), f"{words(rng, 50)} {shuffled}. {words(rng, 50)}", items[4], " ".join(items[3].split()[:12]), *ODD]
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, "too short"), (None, items[0])], "item_id long, text string")
    for size in (2_000_000, 30):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", size)
        got = {r["doc_id"]: r for r in decontam.decontaminate(frame(spark, texts), bench).collect()}
        assert {i for i, r in got.items() if r["contaminated"]} == {1, 2}
        assert got[1]["item_ids"] == [2] and got[1]["coverage"] == 1.0 and got[1]["n_tiles"] == 3
        assert got[2]["item_ids"] == [4] and got[3]["coverage"] == 0.0  # 12 words of 40
    assert not any(r["contaminated"] for r in decontam.decontaminate(frame(spark, texts), bench.limit(0)).collect())
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0


# --- 4 PII ---


@pytest.mark.parametrize("size", [2, 3, 7, 64, 1000])
def test_permutation_is_one_to_one_without_fixed_points(size):
    p = pii.Permutation(b"k", "t", size)
    got = [p(i) for i in range(size)]
    assert sorted(got) == list(range(size)) and all(a != b for a, b in enumerate(got))


def test_surrogates_keep_type_format_and_coreference():
    m = pii.Surrogates(b"key")
    text = 'Mail Ann.12@mail5.Example.com or ANN.12@MAIL5.EXAMPLE.COM; call +1 (523) 555-1055, 523-555-1055. Pay 4111 1111 1111 1111 from 93.184.216.34 or 10.0.0.7. token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e". Mr. John Smith met Mrs. Maria Иванова; Smith left.'
    new, found = m.clean(text)
    kinds = Counter(k for k, *_ in found)
    assert kinds == {"email": 2, "phone": 2, "card": 1, "ip": 2, "hex": 1, "given": 2, "family": 3}
    assert [(k, len(text[a:b])) for k, a, b, _ in found if k in ("email", "phone", "card", "hex")] == [(k, len(s)) for k, _, _, s in found if k in ("email", "phone", "card", "hex")]
    assert not any(text[a:b] in new for _, a, b, _ in found)
    emails = [s for k, _, _, s in found if k == "email"]
    assert emails[0].lower() == emails[1].lower() and emails[1].isupper()
    phones = [re.sub(r"\D", "", s)[-10:] for k, _, _, s in found if k == "phone"]
    assert phones[0] == phones[1] and phones[0][3:6] == "555"
    card = re.sub(r"\D", "", next(s for k, _, _, s in found if k == "card"))
    assert pii._luhn(card[:-1]) == int(card[-1])
    assert "10." in new and len([s for k, _, _, s in found if k == "family" and s == found[-1][3]]) == 2
    given = [s for k, _, _, s in found if k == "given"]
    assert pii.gender_of(given[0]) == "m" and pii.gender_of(given[1]) == "f" and pii.script_of(found[-2][3]) == "cyrillic"


def test_distinct_entities_stay_distinct(spark):
    rng = random.Random(9)
    m = pii.Surrogates(b"key")
    ents = [("phone", f"1{rng.randrange(10**9, 10**10)}") for _ in range(2000)] + [("ip", ".".join(str(rng.randrange(256)) for _ in range(4))) for _ in range(2000)] + [("family", "".join(rng.choice("abeo") for _ in range(rng.randrange(2, 5))) + rng.choice(["", "ov", "son"])) for _ in range(2000)]
    ents += [("given", n.lower()) for names in pii.NAMES.values() for n in names] + [("card", f"{rng.randrange(10**15, 10**16)}") for _ in range(500)]
    rows = spark.createDataFrame([(k, s, m.of(k, s)) for k, s in set(ents)], "kind string, entity string, surrogate string")
    assert pii.collisions(rows).count() == 0
    assert rows.where("entity = surrogate").count() == 0


def test_alphabets_are_classes_of_letters():
    for c in "aekéñłαώβяжйёآ한漢ąß":
        own = pii.alphabet(c)
        assert c in own and all(pii.alphabet(d) == own for d in own[:300:7])
    assert set(pii.alphabet("a")) == set("aeiou") and "é" in pii.alphabet("à") and "ł" in pii.alphabet("ñ") and pii.alphabet("ß") == "ß"


def test_names_of_any_script_change(spark):
    m = pii.Surrogates(b"another key")
    names = ["Παπαδόπουλος", "Łé", "Ééé", "Иванова", "Ёж", "Մինասյան", "Ñandú", "Ą", "O", "Bo", "Schröder-Müller", "ΣΣ", "Ǆ"]
    for n in names:
        new, found = m.clean(f"Then Mr {n} spoke.")
        assert [k for k, *_ in found] == ["family"] and n.lower() not in new.lower().split("mr ")[1].split(), n
        assert new == m.clean(f"Then Mr {n} spoke.")[0]
    assert not {*"Παπαδόπουλο"} & {*m.clean("Mr Παπαδόπουλος")[0][3:]} - {*"αεηιουωάέήίόύώβγδζθκλμνξπρστφχψ"}
    made = {m.of("family", n.lower()) for n in names}
    assert len(made) == len({n.lower() for n in names}) and not made & {n.lower() for n in names}


def test_known_names_without_a_title_and_the_ending_that_tells_the_gender(spark):
    m = pii.Surrogates(b"key")
    new, found = m.clean("Yesterday Sarah Miller met Zoria and Mrs Zoria Quendel. Sarah left.")
    assert Counter(k for k, *_ in found) == {"given": 4, "family": 2}
    given = {text: s for text, s in (("Yesterday Sarah Miller met Zoria and Mrs Zoria Quendel. Sarah left."[a:b], s) for k, a, b, s in found if k == "given")}
    assert pii.gender_of(given["Sarah"]) == "f" and given["Zoria"].endswith("a") and new.count(given["Sarah"]) == 2 and new.count(given["Zoria"]) == 2


def test_no_entity_of_many_survives_its_own_surrogate():
    rng = random.Random(21)
    m = pii.Surrogates(b"k2")
    for _ in range(400):
        own = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))).capitalize() for _ in range(2)]
        mail = f"{own[0].lower()}.{rng.randrange(99)}@{own[1].lower().replace('é', 'e')}x.org"
        phone = f"({rng.randrange(200, 999)}) {rng.choice((555, rng.randrange(200, 999)))}-{rng.randrange(10**4):04}"
        number = f"{rng.randrange(10**3):03}-{rng.randrange(100):02}-{rng.randrange(10**4):04}"
        text = f"Frau {own[0]} {own[1]}: {mail}, {phone}; {number}, password = 'éé{rng.randrange(10**9)}ñ'"
        new, found = m.clean(text)
        assert len(found) >= 6 and all(e not in new for e in (mail, phone, number)), text
        assert all(text[a:b] != s and text[a:b].lower() != s.lower() for _, a, b, s in found), (text, new)


def test_the_key_is_kept_in_the_shared_folder(spark):
    one = pii.run_key(spark)
    assert one == pii.run_key(spark) and len(one) == 32
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.run_key(spark) != one
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_surrogates_of_odd_rows(spark):
    docs = frame(spark, [*ODD, "a@b.co", "a@b.co", "no @ here", "1.2.3.4.5 and 2024-01-02 and 12345"])
    rows = sorted(pii.surrogates(docs, b"key").collect(), key=lambda r: r["doc_id"])
    assert [r["text"] for r in rows[: len(ODD)]] == ODD and rows[len(ODD)]["text"] == rows[len(ODD) + 1]["text"] != "a@b.co"
    assert [r["n_entities"] for r in rows] == [0] * len(ODD) + [1, 1, 0, 0]
    assert pii.surrogates(docs.limit(0), b"key").count() == 0


# --- 5 and 8 tokens ---


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.token_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def test_fast_encoder_gives_the_tokenizers_ids(exact, monkeypatch):
    from sparkloom.llm import bpe

    rng = random.Random(10)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(" \n\tab1.,é!²ßA'") for _ in range(rng.randrange(30))) for _ in range(400)] + ["<|endoftext|> x", "a b", "don't  we'll"]
    for chars in (1 << 20, 50):
        monkeypatch.setattr(bpe, "CHARS", chars)
        ids, at = bpe.Encoder(packing.token_path()).encode(texts)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [exact(t) for t in texts]


def test_fast_encoder_tells_pieces_apart_that_cancel_in_polynomial_sums(exact):
    encoder = bpe.Encoder(packing.token_path())
    for texts in ([MORSE, OTHER_MORSE], [f"{MORSE} {OTHER_MORSE}"], [OTHER_MORSE[:512], MORSE[:512]]):
        ids, at = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [exact(t) for t in texts]


def test_fast_encoder_without_trust_in_its_hashes(exact, monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends, seed=0: ((starts if seed else ends) % 3).astype(np.uint64))
    encoder = bpe.Encoder(packing.token_path())
    texts = ["several longer words, several others", "and more of them"]
    ids, at = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [exact(t) for t in texts]



@pytest.mark.parametrize("block", [3, 1 << 16])
def test_separator_scan_round_trip(spark, exact, monkeypatch, block):
    monkeypatch.setattr(tokencount, "SPAN", 4)
    texts = [*ODD, *near_copies(random.Random(11), 25)]
    rows = tokencount.count_tokens(frame(spark, texts).repartition(2), packing.token_path(), block=block).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(exact(t)) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(frame(spark, []), packing.token_path()).count() == 0


def test_flat_files_with_and_without_a_last_separator(spark, tmp_path):
    rng = np.random.default_rng(12)
    want = {}
    for f in range(3):
        ids = rng.integers(0, 4, 100 + f).astype("<u4")
        ids[-1] = 0 if f else 3
        (tmp_path / f"f{f}.bin").write_bytes(ids.tobytes())
        cut = np.flatnonzero(ids == 0)
        want[f] = [len(p) - (k > 0) for k, p in enumerate(np.split(ids, cut)) if k < len(cut) or ids[-1] != 0]
    got = defaultdict(list)
    for r in tokencount.scan_files(spark, str(tmp_path), eod=0, block=7).orderBy("stream", "ordinal").collect():
        got[r["stream"]].append(r["n_tokens"])
    assert sorted(got.values()) == sorted(want.values())


def test_flat_file_beyond_a_gigabyte_is_scanned_whole(spark, tmp_path):
    n, ends = (1 << 28) + 96, [5, 6, 65536, 40_000_000, (1 << 28) + 90]
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(4 * n)  # tokens 0
        for e in ends:
            f.seek(4 * e)
            f.write(np.array([9], "<u4").tobytes())
    (tmp_path / "small.bin").write_bytes(np.array([1, 9, 2, 9], "<u4").tobytes())
    got = defaultdict(list)
    for r in tokencount.scan_files(spark, str(tmp_path), eod=9).orderBy("stream", "ordinal").collect():
        got[r["stream"]].append(r["n_tokens"])
    assert sorted(got.values()) == sorted([[b - a - 1 for a, b in itertools.pairwise([-1, *ends, n])], [1, 1]])


@pytest.mark.parametrize(("n", "record"), [(4096, 64), (4099, 64), (6000, 7)])
def test_ranges_of_flat_files_against_a_plain_scan(spark, tmp_path, monkeypatch, n, record):
    monkeypatch.setattr(tokencount, "WHOLE", 100)
    monkeypatch.setattr(tokencount, "RANGE", 400)
    monkeypatch.setattr(tokencount, "RECORD", record)
    monkeypatch.setattr(tokencount, "SPAN", 4)
    ids = np.random.default_rng(n).integers(0, 30, n).astype("<u4")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.local.block.size", "1000")
    try:
        (tmp_path / "a,{b}.bin").write_bytes(ids.tobytes())
        got = [(r["start"], r["n_tokens"]) for r in tokencount.scan_files(spark, str(tmp_path), eod=0, block=50).orderBy("ordinal").collect()]
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("fs.local.block.size")
    cut = [-1, *np.flatnonzero(ids == 0).tolist(), *([n] if ids[-1] else [])]
    assert got == [(a + 1, b - a - 1) for a, b in itertools.pairwise(cut)]
    (tmp_path / "a,{b}.bin").write_bytes(ids.tobytes() + b"x")
    with pytest.raises(ValueError, match="last whole token"):
        tokencount.scan_files(spark, str(tmp_path), eod=0, block=50)


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_length_once_and_packs_tightly(seed):
    rng = random.Random(seed)
    hist = Counter(rng.choice([rng.randint(1, 64), rng.randint(20, 40)]) for _ in range(500))
    patterns = packing.plan(hist, 64)
    used = Counter()
    for own, times in patterns:
        assert sum(own) <= 64
        for x in own:
            used[x] += times
    assert used == hist
    bins, total = sum(t for _, t in patterns), sum(k * v for k, v in hist.items())
    assert bins <= 1.06 * -(-total // 64) + 1 or bins <= sum(v for k, v in hist.items() if k > 32) + 1


def test_two_fit_replaces_the_smallest():
    assert packing.plan({60: 1, 30: 1, 22: 1, 17: 1}, 100) == [((60, 22, 17), 1), ((30,), 1)]


def test_packing_round_trip(spark, exact):
    rng = random.Random(13)
    texts = [*ODD, *[words(rng, n, 50) for n in (3, 40, 900, 1700, 333)], "same", "same"]
    ids = [*range(len(texts) - 2), 500, 500]
    rows = packing.pack(frame(spark, texts, ids), packing.token_path()).collect()
    text = dict(zip(ids, texts, strict=True))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] != 500:
            pieces[r["doc_id"]].append(r)
    for i, own in pieces.items():
        full = np.array([*exact(text[i]), 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(full[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(full) and (len(own) == 1 or len(full) > 1024)
    assert len(rows) - sum(map(len, pieces.values())) == 2
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(frame(spark, []), packing.token_path()).count() == 0


# --- 6 licences ---


def licences_of(text):
    return [m[0] for m in licenses.match(licenses.identify(text))]


def test_license_texts_in_any_layout():
    for name, _, text in licenses.TEXTS:
        lines = text.split(" ")
        wrapped = "\n".join(" * " + " ".join(lines[i : i + 9]) for i in range(0, len(lines), 9))
        for t in (text, text.upper(), f"Copyright 2020 X\n\n{text}\n\nSome other words.", wrapped):
            assert set(licences_of(t)) == {name} and len(licences_of(t)) == 1, (name, t)
    for name, seq in licenses.RULES:
        assert licenses.match([(i, i + 1, k) for i, k in enumerate(seq)])[0][0] == name


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Some words here\nThis work is licensed under the GNU General Public License, version 3.\nmore words. LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.!! and more", ["GPL-3.0-only", "Apache-2.0"]),
        ("This code is licensed under the MIT license.", ["MIT"]),
        ("Released under GPLv3.", ["GPL-3.0-only"]),
        ("Distributed under the terms of the Mozilla Public Licence, version 2.0", ["MPL-2.0"]),
        ("This project is dual licensed under the MIT License or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: GPL-2.0+\nimport os", ["GPL-2.0-or-later"]),
        ("// SPDX-License-Identifier: (ISC OR Apache-2.0)\n", ["ISC", "Apache-2.0"]),
        ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", ["GPL-2.0-only"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("We licensed the song. A permission slip. The book is available under the counter.", []),
        ("Released under the MIT License" + " " * 5000 + ".", ["MIT"]),
    ],
)
def test_license_notices(text, want):
    assert licences_of(text) == want


def test_license_match_against_every_rule_at_every_place():
    """The first of all rules, longest first, that fits at a place; then on behind it."""
    rng = random.Random(41)
    ids = sorted(set(licenses.KNOWN.values()) | {k for _, seq in licenses.RULES for k in seq})
    for _ in range(300):
        seq: list = []
        while len(seq) < 12:
            seq += rng.choice(licenses.RULES)[1] if rng.random() < 0.7 else [rng.choice(ids)]
        want, i = [], 0
        while i < len(seq):
            fits = [(len(r), name) for name, r in licenses.RULES if seq[i : i + len(r)] == r]
            best = max((n for n, _ in fits), default=0)
            if best:
                want.append((next(name for n, name in fits if n == best), i, i + best))
            i += best or 1
        assert licenses.match([(k, k + 1, x) for k, x in enumerate(seq)]) == want


def test_license_scan_of_odd_rows(spark):
    docs = frame(spark, [*ODD, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0."])
    rows = sorted(licenses.scan(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["licenses"] for r in rows] == [[]] * len(ODD) + [["CC-BY-NC-4.0"]] * 2
    assert licenses.scan(docs.limit(0)).count() == 0


# --- 7 quality, 9 language ---


def test_quality_on_held_out_rows(spark):
    rng = random.Random(14)
    texts = [words(rng, 60).capitalize() + "." if i % 3 else words(rng, 60).upper() + "!!" for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(frame(spark, texts), labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 40 and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in quality.classify(frame(spark, texts), labels.limit(0)).collect()} == {1.0}
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_language_on_held_out_rows(spark):
    rng = random.Random(15)
    parts = {"en": ["the", "th", "ing", "er", "and"], "fr": ["le", "eau", "oui", "ç", "ment"], "es": ["el", "ción", "ñ", "ado", "que"]}
    langs, texts = {}, []
    for i in range(360):
        langs[i] = list(parts)[i % 3]
        texts.append(" ".join("".join(rng.choices(parts[langs[i]], k=rng.randrange(1, 4))) for _ in range(12)))
    odd = [None, "", "123 456 ...", "—„“", "世界"]
    rows = {r["doc_id"]: r for r in langid.identify(frame(spark, texts + odd, langs=langs)).collect()}
    held = [r for i, r in rows.items() if r["held_out"] and i < 360]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert len(held) > 50 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert [rows[360 + k]["lang_pred"] for k in range(4)] == ["und"] * 4 and rows[364]["lang_pred"] in parts
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert {r["lang_pred"] for r in langid.identify(frame(spark, texts[:3])).collect()} == {"und"}


# --- 10 embeddings ---


def brute_links(rows, cosine=0.98):
    good = {i: (label, np.array(v) / np.linalg.norm(v)) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {i: set() for i, _, _ in rows}
    for a, b in itertools.combinations(good, 2):
        if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine:
            links[a].add(b)
            links[b].add(a)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += links[j]
    return links, root


@pytest.mark.parametrize("block", [1024, 8])
def test_forest_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(16)
    base = rng.standard_normal((150, 16))
    rows = [(i, (base[i // 4] + rng.standard_normal(16) * (0.0 if i % 4 == 1 else 0.06)).tolist(), i // 4 % 3) for i in range(500)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [None] * 16, 1), (604, [float("nan")] * 16, 1), (605, rows[0][1], None), (606, [1.0, 2.0], 1), (607, [1.0, 2.0], 1), (608, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("weight", F.lit("clash"))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df, leaf=16).collect()}
    links, root = brute_links(rows)
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and total > 300
    assert all(got[i]["n_links"] <= len(v) for i, v in links.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * total
    assert sum(got[i]["component_id"] == root[i] for i in root) >= 0.97 * len(root)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "labels"), [("string", ["a", "b", None]), ("double", [1.2, 1.9, 0.0]), ("int", [1, 2, 3])])
def test_labels_of_any_type_null_ids_repeats_and_many_lengths(spark, kind, labels):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, labels[0]), (2, one, labels[1]), (None, one, labels[0]), (None, [1.0, 2.0, 3.01], labels[0]), (4, [1.0, 2.0, 3.02], labels[0])]
    rows += [(5, [0.0, 1.0, 0.0], labels[0]), (5, [0.0, 0.0, 1.0], labels[0]), (6, [0.0, 0.01, 1.0], labels[0])]
    rows += [(100 + 2 * n + i, [1.0] * n + [9.0 + i / 100], labels[1]) for n in range(3, 24) for i in (0, 1)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    got = neardup.near_duplicates(df).collect()
    tell = lambda i: sorted((r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == i)
    assert len(got) == len(rows)
    assert tell(1) == [(3, 1, True)] and tell(4) == [(3, 1, False)] and tell(2) == [(0, 2, True)]
    assert tell(None) == [(3, 1, False)] * 2
    assert tell(5) == [(0, 5, True), (1, 5, True)] and tell(6) == [(1, 5, False)]
    assert all(tell(100 + 2 * n) == [(1, 100 + 2 * n, True)] and tell(101 + 2 * n) == [(1, 100 + 2 * n, False)] for n in range(3, 24))


# --- pipeline ---


def test_pipeline_stages_hold_what_they_promise(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in p.STAGES][1] == "n-gram Jaccard join" and len(p.STAGES) == 5
    kept = p.STAGES[0][1](spark, docs, sf)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    one = {r["doc_id"]: r["text"] for r in p.STAGES[1][1](spark, kept, sf).collect()}
    assert set(one) == {root for _, root in brute_components(texts).values()} and all(one[i] == texts[i] for i in one)
    left = p.STAGES[2][1](spark, kept, sf)
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    assert {r["doc_id"] for r in left.collect()} == {i for i, t in texts.items() if not any(norm(b) in norm(t) for b in bench)}
    clean = p.STAGES[3][1](spark, left, sf)
    assert clean.columns == docs.columns and not any(pii.NUMBERS.search(r["text"]) and texts[r["doc_id"]] == r["text"] for r in clean.collect() if pii.find(r["text"]))
    out = p.run(spark, sf)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 0


# --- operators against slow versions of themselves ---


def test_contexts_against_plain_loops():
    import pandas as pd

    rng = random.Random(51)
    texts = [" ".join(rng.choice(["Ab", "ab", "c1", "d.", "E-e", "éa"]) for _ in range(n)) for n in (0, 1, 2, 9, 40)] + [None]
    got = next(quality._contexts(iter([pd.DataFrame({"text": texts})])))["sums"][0]
    got = np.frombuffer(got, "<i4").reshape(2 * quality.UNITS, quality.DIM)
    index, want = quality.index_vectors(), np.zeros((2 * quality.UNITS, quality.DIM))
    for t in texts:
        words_, shapes, _, _ = quality.units([(t or "").encode()])
        for i in range(len(words_)):
            for j in range(max(0, i - quality.WINDOW), min(len(words_), i + quality.WINDOW + 1)):
                if i != j:
                    for own in (words_[i], shapes[i]):
                        want[own] += index[words_[j]] + index[shapes[j]]
    assert (got == want).all() and want.any()


def test_features_against_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "GROUP_TEXTS", 3)
    rng = random.Random(52)
    vectors = np.random.default_rng(3).standard_normal((2 * quality.UNITS, quality.DIM)).astype(np.float32)
    texts = [words(rng, n, 12).encode() for n in (0, 1, 2, 3, 30, 200, 1, 50)] + [b"One\nTwo two TWO"]
    got = quality.features(texts, quality.pooling_table(vectors))
    for row, t in zip(got, texts, strict=True):
        own, shapes, full, _ = quality.units([t])
        n = len(own)
        if not n:
            assert not row.any()
            continue
        v, s = vectors[own].astype(float), vectors[shapes].astype(float)
        runs = [tuple(full[i : i + 3].tolist()) for i in range(n - 2)]
        plain = [np.log1p(n), len(set(full.tolist())) / n, len(set(runs)) / max(1, n - 2), len(t) / n, t.count(b"\n") / n, 1]
        assert np.allclose(row, np.concatenate((v.mean(axis=0), s.mean(axis=0), s.std(axis=0), plain)), atol=1e-3)


def test_temperature_calibrates():
    rng = np.random.default_rng(53)
    x = rng.standard_normal((6000, 8))
    y = (rng.random(6000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    model = quality.train(x[:4000], y[:4000])
    p = quality.score(model, x[4000:])
    loss = lambda q: -np.mean(y[4000:] * np.log(q) + (1 - y[4000:]) * np.log(1 - q))
    sharp = quality.score(model | {"temperature": model["temperature"] / 3}, x[4000:])
    assert 0.25 <= model["temperature"] <= 8 and loss(np.clip(p, 1e-9, 1 - 1e-9)) < loss(np.clip(sharp, 1e-9, 1 - 1e-9))
    for lo, hi in ((0.1, 0.35), (0.35, 0.65), (0.65, 0.9)):
        inside = (p >= lo) & (p < hi)
        assert abs(p[inside].mean() - y[4000:][inside].mean()) < 0.08


def test_word_first_backoff_against_plain_loops(spark):
    rng = random.Random(54)
    langs = {i: ("en", "xx")[i % 2] for i in range(200)}
    texts = [" ".join("".join(rng.choice(("aeiou", "bcdfg")[i % 2] + "lm") for _ in range(rng.randrange(2, 7))) for _ in range(30)) for i in range(200)]
    model = langid.fit(frame(spark, texts, langs=langs))
    for t in [*texts[:5], "aeli bcd zzz", "qqq", "lm ml aaaaaa"]:
        total = np.zeros(len(model["langs"]))
        for w in t.split():
            h = textscan.word_hashes([w.encode()], langid.ONLY_LETTERS)[0][0]
            if h in model["keys"]:
                s = model["words"][np.searchsorted(model["keys"], h)].astype(float)
            else:
                s = np.zeros(len(model["langs"]))
                flat = np.frombuffer(b"\x01" + w.encode() + b"\x01", np.uint8)
                for order in langid.ORDERS:
                    known, shares = model["grams"][order]
                    keys = [int(textscan.ngram_hashes(flat[i : i + order].astype(np.uint64) + np.uint64(1), order)[0] >> np.uint64(20)) & (langid.GRAMS - 1) for i in range(len(flat) - order + 1)]
                    keys = [k for k in keys if known[k]]
                    if keys:
                        s = np.mean([shares[k].astype(float) for k in keys], axis=0)
                        break
            total += s - s.max()
        best, share = langid.predict(model, [t.encode()])
        assert best[0] == total.argmax() and 0 <= share[0] <= 1


def test_a_rare_language_is_learned(spark):
    rng = random.Random(55)
    common = [" ".join("".join(rng.choices("abcde", k=4)) for _ in range(20)) for _ in range(600)]
    rare = [" ".join("".join(rng.choices("wxyz", k=4)) for _ in range(20)) for _ in range(12)]
    langs = {i: "aa" if i < 600 else "zz" for i in range(612)}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, common + rare, langs=langs)).collect()}
    assert all(got[600 + i] == "zz" for i in range(12)) and sum(v == "aa" for v in got.values()) == 600


def slow_two_fit(lengths, capacity):
    """Best-two-fit document by document."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        own, gap = [left.pop(0)], 0
        gap = capacity - own[0]
        i = 0
        while i < len(left):
            if left[i] <= gap:
                gap -= left[i]
                own.append(left.pop(i))
            else:
                i += 1
        while gap and len(own) > 1:
            small = min(own)
            pairs = [(a + b, i, j) for i, a in enumerate(left) for j, b in enumerate(left) if i < j and small < a + b <= gap + small]
            if not pairs:
                break
            s, i, j = max(pairs)
            own.remove(small)
            own += [left[i], left[j]]
            for k in (j, i):
                del left[k]
            left.append(small)
            left.sort(reverse=True)
            gap += small - s
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_plan_needs_as_few_bins_as_document_by_document(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 65) for _ in range(120)]
    patterns = packing.plan(Counter(lengths), 64)
    assert abs(sum(n for _, n in patterns) - slow_two_fit(lengths, 64)) <= 1


# --- every operator on odd tables ---


OPERATORS = {
    "op1": lambda spark, docs: sharding.reshard(docs, F.lit(0), 2, shards=3),
    "op2": lambda spark, docs: jaccard.ngram_jaccard_join(docs),
    "op3": lambda spark, docs: decontam.decontaminate(docs, spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")).select("doc_id", "coverage", "item_ids"),
    "op4": lambda spark, docs: pii.surrogates(docs, b"key"),
    "op5": lambda spark, docs: tokencount.count_tokens(docs, packing.token_path()).select("doc_id", "n_tokens"),
    "op6": lambda spark, docs: licenses.scan(docs),
    "op7": lambda spark, docs: quality.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")),
    "op8": lambda spark, docs: packing.pack(docs, packing.token_path()).select("doc_id", "piece", "length", "ids_crc32"),
    "op9": lambda spark, docs: langid.identify(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_ties_clashing_columns_and_nothing(spark, name):
    run = OPERATORS[name]
    long = " ".join(f"w{i % 977}" for i in range(600_000))  # 3 MB
    texts = [None, None, "", "one two three four five six seven", "one two three four five six seven", "a@b.co", long, long + " end"]
    ids = [None, 1, 2, 3, 3, None, 7, 8]
    names = ["score", "shard", "coverage", "lang_pred", "row", "slot", "n_entities", "weight", "token"]
    docs = frame(spark, texts, ids, langs={1: "en", 3: "en", 7: None, 8: "fr"}).select("*", *(F.lit(float("nan")).alias(n) for n in names))
    rows = run(spark, docs).collect()
    seen = Counter(r["doc_id"] for r in rows)
    if name == "op8":
        assert set(seen) == set(ids) and sum(r["length"] for r in rows if r["doc_id"] == 7) + 1 <= sum(r["length"] for r in rows if r["doc_id"] == 8)
    else:
        assert seen == Counter(ids)
    alike = [tuple(r.asDict(True).items()) for r in rows if r["doc_id"] == 3]
    if name not in ("op1", "op8"):
        assert repr(alike[0]) == repr(alike[1])
    assert run(spark, docs.limit(0)).count() == 0


def test_stages_keep_other_columns_as_they_are(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumn("coverage", F.lit(0.77)).withColumn("contaminated", F.lit("mine")).withColumn("_x", F.lit(float("nan"))).withColumn("tags", F.array(F.lit(1.5), F.lit(None).cast("double")))
    for stage in (decontam.drop_contaminated, pii.clean_stage, quality.keep_good, jaccard.keep_one):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert all(r["coverage"] == 0.77 and r["contaminated"] == "mine" and r["_x"] != r["_x"] and r["tags"] == [1.5, None] for r in out.collect())


def test_sets_with_one_key_are_told_apart(spark, monkeypatch):
    texts = ["a b c d e f", "g h i j k l", "a b c d e f", None, "m n o p q r s"]
    want = [0, 1, 0, 3, 4]
    got = jaccard._names(spark.createDataFrame([(i, n, node, chk, 0, 0) for i, (n, node, chk) in enumerate([(2, 5, 1), (2, 5, 9), (2, 5, 1), (0, None, None), (3, 6, 7)])], "doc_id long, n long, node long, chk long, k1 long, k2 long"))
    rows = {r["doc_id"]: r["node"] for r in got[0].collect()}
    assert rows[0] == rows[2] == 5 != rows[1] and rows[1] == got[2][5][9] and rows[4] == 6 and rows[3] is None
    assert {r["node"]: (r["least"], r["weight"]) for r in got[1].collect()} == {5: (0, 2), rows[1]: (1, 1), 6: (4, 1)}
    assert [r["component_id"] for r in sorted(jaccard.ngram_jaccard_join(frame(spark, texts), links=False).collect(), key=lambda r: r["doc_id"])] == want


def test_words_that_cancel_in_polynomial_sums_do_not_link(spark):
    docs = frame(spark, [MORSE, OTHER_MORSE, " ".join([MORSE] * 9), " ".join([OTHER_MORSE] * 9)])
    assert [r["component_id"] for r in sorted(jaccard.ngram_jaccard_join(docs).collect(), key=lambda r: r["doc_id"])] == [0, 1, 2, 3]


def test_one_row_of_each_group_stays_under_null_and_repeated_ids(spark):
    a, b, c = "one two three four five six", "other words of its own here", "a third text that nobody else has"
    docs = frame(spark, [a, b, a, c, c, c, None, None, "", b + "!"], [1, 2, 2, None, None, 7, None, None, 8, 3])
    rows = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark, docs, "").collect()), key=repr)
    assert rows == sorted([(1, a), (2, b), (7, c), (None, None), (None, None), (8, ""), (3, b + "!")], key=repr)
    again = frame(spark, [c, c, c], [None, None, None])
    assert [(r["doc_id"], r["text"]) for r in jaccard.keep_one(spark, again, "").collect()] == [(None, c)]
    assert jaccard.keep_one(spark, docs.limit(0), "").count() == 0


def test_the_driver_gets_one_packed_matrix_and_one_sketch(spark, monkeypatch):
    """Matrices of 6 MB from each task, the features and eight sketches once took the driver beyond its memory."""
    import pickle

    rng, got, sent = random.Random(61), [], []
    rows_of, context = type(spark.range(0)), type(spark.sparkContext)
    monkeypatch.setattr(rows_of, "collect", lambda self, f=rows_of.collect: got.append(f(self)) or got[-1])
    monkeypatch.setattr(context, "broadcast", lambda self, value, f=context.broadcast: sent.append(len(pickle.dumps(value))) or f(self, value))
    docs = frame(spark, [words(rng, 80) for _ in range(120)]).repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is not None
    jaccard.ngram_jaccard_join(docs, links=False)
    binary = [len(v) for rows in got for r in rows for v in r if isinstance(v, (bytes, bytearray))]
    assert got and sent and sum(binary) < 1 << 20 and sum(sent) < 1 << 20
    assert sum("sketch" in r.asDict() for rows in got for r in rows) == 1


def test_workers_give_memory_back_before_and_after_their_batches(monkeypatch):
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(common, "give_back", lambda f=common.give_back: calls.append(f()))
    batch = pa.RecordBatch.from_pydict({"x": list(range(10))})
    assert [len(calls) for _ in common.small(iter([batch, batch]))] == [1, 1] and len(calls) == 2
