"""The operators against brute force on small tables, with edge cases: nulls, empty and long texts, repeated rows, other columns."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import math
import random
import zlib

import public_tokenizers
import pytest

from quillon.llm import decontamination, labelled, packing, partenum, phrase_automata, quality_embeddings, secrets_forest, suffix_levels, topk_bond, toxicity_fm, warc_derivatives

VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)

    def said(n):
        return " ".join(rng.choice(VOCABULARY) for _ in range(n))

    passage = said(70)
    rows = []
    for k in range(60):
        words = said(rng.choice([3, 5, 12, 60, 150])).split()
        if k % 4 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage.split()[rng.randrange(5):]
        rows.append((k, " ".join(words)))
    for k in range(60, 90):  # near copies
        words = rng.choice(rows)[1].split()
        for _ in range(max(1, len(words) // rng.choice([15, 30, 60]))):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        rows.append((k, " ".join(words)))
    rows += [(90, rows[7][1]), (91, rows[7][1].upper()), (92, None), (93, ""), (94, " \t\n"), (95, "one two"), (96, "one  two"), (97, said(4000)), (98, rows[8][1] + " " + rows[8][1]), (99, "ä" * 300)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    # Columns whose names operators use themselves.
    return spark.createDataFrame([(i, t, "x", k, 1.5) for k, (i, t) in enumerate(corpus())], "doc_id long, text string, sig string, n int, component double").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def words_of(text):
    return (text or "").replace("\t", " ").replace("\n", " ").split(" ")


def shingles(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").split() if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components_of(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return {(i, len(s), top(i)) for i, s in sets}


def test_partenum_equals_all_pairs(documents, empty):
    got = {tuple(r) for r in partenum.joined(documents).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == components_of(corpus())
    assert partenum.joined(empty).count() == 0


def near_copies(n: int, words: int = 60, most: int = 3, seed: int = 5) -> list[tuple]:
    """Copies of one text, with up to ``most`` of its words changed, so that only some pairs are similar."""
    rng = random.Random(seed)
    base = [rng.choice(VOCABULARY) for _ in range(words)]
    rows = []
    for k in range(n):
        changed = list(base)
        for _ in range(rng.randrange(most + 1)):
            changed[rng.randrange(words)] = rng.choice(VOCABULARY)
        rows.append((k, " ".join(changed)))
    return rows


def test_partenum_large_groups_by_blocks(spark, monkeypatch):
    """Groups beyond the limits of blocks, with hot signatures and frequent shingles, give the same components."""
    for name, value in (("BLOCK", 8), ("LEAST", 3), ("RARE", 8)):
        monkeypatch.setattr(partenum, name, value)
    rows = near_copies(60)
    got = {tuple(r) for r in partenum.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_partenum_group_of_thousands(spark):
    """The shipped limits, and a group beyond a block: rows out of cells stay below the number of sets."""
    rows = near_copies(3000, 40, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {tuple(r) for r in partenum.joined(df).collect()}
    # By the number of words that two texts have in other places; a text meets its near ones by the places that it changed.
    sets = {t: shingles(t) for _, t in rows}
    least: dict[str, int] = {}
    for i, t in rows:
        least.setdefault(t, i)
    texts = sorted(sets, key=least.get)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            root[t] = root[root[t]]
            t = root[t]
        return t

    holders: dict[tuple, list[int]] = {}
    for k, t in enumerate(texts):
        counts: dict[int, int] = {}
        for x in sets[t]:
            for j in holders.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            holders[x].append(k)
        for j, n in counts.items():
            if 100 * n >= 80 * (len(sets[t]) + len(sets[texts[j]]) - n):
                a, b = sorted((top(t), top(texts[j])), key=least.get)
                root[b] = a
    assert got == {(i, len(sets[t]), least[top(t)]) for i, t in rows}


def test_partenum_signatures_within_a_component_give_no_rows(spark, monkeypatch):
    """Near copies share hundreds of signatures, in all tasks; once joined, and two that were compared, they leave none of them."""
    taken = []
    whole = partenum.settled
    monkeypatch.setattr(partenum, "settled", lambda df, name: taken.append(whole(df, name)) or taken[-1] if name == "buckets" else whole(df, name))
    monkeypatch.setattr(partenum, "forget", lambda *frames: None)
    rows = near_copies(20, 400, 1)
    # Pairs that share many signatures, but too few shingles to be similar: 22 words apart change 110 of 396.
    for k in range(20):
        words = [f"p{k}x{i}" for i in range(400)]
        rows += [(100 + 2 * k, " ".join(words)), (101 + 2 * k, " ".join("else" if i % 18 == 9 else w for i, w in enumerate(words)))]
    got = {tuple(r) for r in partenum.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows) and len({r[2] for r in got}) == 41
    assert len(taken) == 1 and taken[0].count() <= 15


def test_partenum_signatures_are_shared_by_similar_sets():
    """Whatever is frequent, and in whatever shingles they differ: PartEnum's promise, on random sets of all sizes."""
    import numpy as np

    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 5, 8, 9, 17, 18, 40, 100, 301]:
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, n // 9 + 1))
            more = rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1))).astype(np.uint64)
            y = np.concatenate([x[gone:], more])
            common = n - gone
            if 5 * common < 4 * (n + len(more)):
                continue
            frequent = np.sort(x[rng.random(n) < rng.random()])
            signed = [set(partenum.signatures(np.sort(s), np.array([0, len(s)]), frequent)[1].tolist()) for s in (x, y)]
            assert signed[0] & signed[1]


def test_partenum_links_sizes_of_two_families_in_any_pieces(spark):
    """A set emits all its families also where it is the largest of its piece: one row a partition."""
    rows = []
    for k, (few, many) in enumerate([(4, 5), (7, 8), (160, 180), (440, 455)]):
        # n shingles are n + 4 words; the shorter text begins the longer one.
        words = [f"s{k}x{i}" for i in range(many + 4)]
        rows += [(2 * k, " ".join(words[: few + 4])), (2 * k + 1, " ".join(words))]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {tuple(r) for r in partenum.joined(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == components_of(rows) and {r[2] for r in got} == {0, 2, 4, 6}


def test_partenum_null_ids_and_repeated_ids(spark):
    text = " ".join(VOCABULARY[:20])
    rows = [(None, text), (5, text), (5, "a b c d e f"), (7, "a b c d e f"), (9, text)]
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in partenum.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(None, None), (5, 5), (5, 5), (7, 5), (9, 5)]))


def test_phrase_automata_equals_brute_force(documents, empty):
    rows = sorted(corpus())
    first, want = {}, {}
    for i, t in rows:
        w = (t or "").split()
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    for i, t in rows:
        w = (t or "").split()
        gone = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrase_automata.deduplicated(documents).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert phrase_automata.deduplicated(empty).count() == 0


def test_suffix_levels_equal_brute_force(documents, empty):
    size, count, want = 200, {}, {}
    for _, t in corpus():
        b = (t or "").encode()
        for a in range(len(b) - size + 1):
            count[b[a : a + size]] = count.get(b[a : a + size], 0) + 1
    for i, t in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - size + 1):
            if count[b[a : a + size]] > 1:
                gone[a : a + size] = b"\1" * size
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_levels.deduplicated(documents).collect()}
    assert got == want
    assert suffix_levels.deduplicated(empty).count() == 0


def test_topk_equals_all_scores(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(20)], "z") for k in range(300)]
    rows += [(301, None, "z"), (302, [1.0, None], "z"), (303, [float("nan")], "z"), (304, [float("inf")], "z"), (305, [0.5, 0.5], "z"), (400, rows[0][1], "z"), (None, [1.0] * 20, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    import numpy as np

    held = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v, _ in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (k for k in held if k % 100 == 0):
        best = sorted(((-sum(a * b for a, b in zip(held[q], v)), k) for k, v in held.items() if k != q))[:10]
        want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(best)}
    got = {tuple(r) for r in topk_bond.nearest(df, df["vec_id"] % 100 == 0).collect()}
    assert got == want
    assert topk_bond.nearest(df.where("false"), df["vec_id"] % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [1.0, 60.0, 3e4, 1e6, 1e12, 1e300, 1.7e305])
def test_topk_is_exact_for_components_of_any_size(spark, size):
    """Ties at the last rank, repeated ids, vectors of other lengths, and scores beyond 2**53 and beyond a long."""
    from fractions import Fraction

    rng = random.Random(int(size))
    rows = [(k % 230, [rng.choice([-1, 1]) * rng.uniform(0.9, 1) * size for _ in range(rng.choice([16, 16, 16, 5]))]) for k in range(260)]
    rows += [(500 + k, rows[3][1]) for k in range(25)] + [(600, [0.0] * 16), (700, [])]
    held = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows]
    lim = (1 << 63) - 1
    want = []
    for i, q in held:
        if i % 100 == 0:
            best = sorted((-max(-lim - 1, min(lim, sum(a * b for a, b in zip(q, c)))), j) for j, c in held if j != i)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_bond.nearest(df, df["vec_id"] % 100 == 0).collect())) == sorted(want)


def test_topk_drops_candidates_early():
    """Bounds do the work: with mass in few dimensions, most candidates are gone before the last step."""
    import numpy as np

    rng = np.random.default_rng(3)
    columns = np.floor(1000 * rng.normal(size=(64, 4000)) * np.geomspace(1, 0.001, 64)[:, None])
    block, seen = topk_bond.Block(np.arange(4000), columns), []
    queries = topk_bond.Queries(np.arange(10), columns[:, :10], 10)
    take = queries.take
    queries.take = lambda place, ids, scores: (seen.append(len(ids)), take(place, ids, scores))
    queries.meet(block)
    assert max(seen) < 40
    for i in range(10):
        scores = columns[:, i] @ columns
        scores[i] = -np.inf
        top = np.lexsort((np.arange(4000), -scores))[:10]
        assert queries.best[i] == [(int(scores[j]), int(j)) for j in top]


def test_topk_query_blocks_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """A block that is made again in another fetch order is the same, so that all salts agree on the places of queries."""
    import pyarrow as pa

    rng = random.Random(9)
    rows = [(k % 40, [rng.uniform(-1, 1) for _ in range(rng.choice([3, 5]))]) for k in range(60)] + [(7, []), (7, [0.5]), (7, [0.5, 0.0])]
    made = []
    # applyInArrow's function, whatever its name and place.
    group = type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(group, "applyInArrow", lambda self, f, schema, real=group.applyInArrow: (made.append(f), real(self, f, schema))[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topk_bond.nearest(df, df["vec_id"] >= 0)
    blocks = set()
    for _ in range(5):
        rng.shuffle(rows)
        part = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
        blocks.add(tuple(map(str, made[0]((pa.scalar(0),), part).to_pylist())))
    assert len(blocks) == 1


def test_packing_is_a_round_trip(documents, empty):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus()}
    pieces = packing.packed(documents, path).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, rows in by_doc.items():
        done = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            part = ids[i][r["start"] : r["start"] + r["length"]]
            assert r["start"] == done and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            done += r["length"]
        assert done == len(ids[i])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for rows in by_sequence.values():
        done = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == done
            done += r["length"]
        assert done <= packing.SIZE
    assert sum(map(len, ids.values())) > 0.9 * packing.SIZE * (len(by_sequence) - 1)
    assert packing.packed(empty, path).count() == 0


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(4)
    item = [rng.choice(VOCABULARY) for _ in range(40)]
    changed = [w if k % 9 != 4 else "other" for k, w in enumerate(item)]
    clean = [rng.choice(VOCABULARY) for _ in range(400)]
    docs = spark.createDataFrame([(1, " ".join([*clean[:90], *item, *clean[90:]])), (2, " ".join([*clean[:50], *changed, *clean[50:]])), (3, " ".join(clean)), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (2, 1)}
    whole = next(r for r in rows if r["doc_id"] == 1)
    assert (whole["start_word"], whole["n_words"], whole["n_equal"]) == (90, 40, 40)
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0
    assert decontamination.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_finds_whatever_keeps_four_fifths(spark):
    """All ways to change 2 or 3 of 15 words, and many to change 4 of 20, wherever the changed words are; not 4 of 15."""
    rng = random.Random(8)
    items = {1: [f"a{i}" for i in range(15)], 2: [f"b{i}" for i in range(20)], 3: [f"c{i}" for i in range(40)]}
    gone = [(1, x) for n in (2, 3, 4) for x in itertools.combinations(range(15), n)] + [(2, x) for x in [(4, 9, 14, 19), *(tuple(rng.sample(range(20), 4)) for _ in range(300))]]
    # 16 words of a longer item, of which every fifth is changed.
    gone += [(3, (*range(10), 13, 18, 23, *range(26, 40)))]
    rows = [(k, " ".join(["before"] * 5 + [f"x{i}" if i in x else w for i, w in enumerate(items[item])] + ["after"] * 5)) for k, (item, x) in enumerate(gone)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["n_equal"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert got.keys() == {(k, item) for k, (item, x) in enumerate(gone) if (item, len(x)) != (1, 4)}
    middle = gone.index((1, (6, 7, 8)))
    assert got[middle, 1] == (5, 15, 12)


def test_decontamination_of_repeated_words_gives_a_row_a_stretch(spark):
    twice = [f"a{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(["same"] * 2000)), (2, " ".join([*twice, *["between"] * 30, *twice]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(["same"] * 50)), (8, " ".join(twice))], "item_id long, text string")
    got = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    assert got == [(1, 7, 0, 2000, 50), (2, 8, 0, 20, 20), (2, 8, 50, 20, 20)]


def test_pipeline_drops_leaks_of_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, f"so {item} it"), (None, "clean words"), (None, None), (1, item), (2, "clean words"), (3, None), (None, f"so {item} it")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r) for r in rows if item not in (r[1] or ""))


@pytest.mark.parametrize("of", ["toxic", "quality"])
def test_classifiers_learn_and_score_every_row(spark, of):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        bad = k % 2
        words = [rng.choice(VOCABULARY) for _ in range(40)]
        if bad:
            words[::8] = ["awful"] * 5
        rows.append((k, " ".join(words), "s"))
        labels.append((k, bad))
    rows += [(300, None, "s"), (301, "", "s"), (None, "awful", "s"), (302, "w1 " * 50000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marked = spark.createDataFrame([*labels, (5, None), (None, 1)], f"doc_id long, {of} int")
    module, held_out = (toxicity_fm, labelled.bucket_of(5) == 0) if of == "toxic" else (quality_embeddings, labelled.bucket_of(3) == 1)
    got = module.score(docs, module.train(docs, marked, held_out), held_out).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    known = dict(labels)
    test = [r for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in test) > 0.85 * len(test)
    assert {r["held_out"] for r in got if r["doc_id"] is not None and (zlib.crc32(str(r["doc_id"]).encode()) % (5 if of == "toxic" else 3) == (0 if of == "toxic" else 1))} == {True}
    unlabelled = module.score(docs, module.train(docs, marked.where("false"), held_out), held_out)
    assert {r["score"] for r in unlabelled.collect()} == {0.5}


def test_secrets_are_found_and_masked(spark):
    model = secrets_forest.train(secrets_forest.findings(spark))
    key = "ghp_" + hashlib.sha256(b"x").hexdigest()[:36]
    rows = [(1, f"see {key} here", "src0"), (2, "plain words only", "src0"), (3, None, None), (4, "", "src0"), (5, f"a {key} b {key} c", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets_forest.scan(docs, model).where("is_secret").collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in found) == [(1, 4, 40), (5, 2, 40), (5, 45, 40)]
    texts = {r["doc_id"]: r["text"] for r in secrets_forest.redact(docs, model).collect()}
    assert texts == {1: "see [SECRET] here", 2: "plain words only", 3: None, 4: "", 5: "a [SECRET] b [SECRET] c"}
    assert secrets_forest.scan(docs.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, f"a\x01b {key} \x02\x01c {key}\x02", "s"), (2, f"\x02{key}", None)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in secrets_forest.redact(odd, model).collect()} == {1: "a\x01b [SECRET] \x02\x01c [SECRET]\x02", 2: "\x02[SECRET]"}


def test_warc_records_link_and_read_back(spark):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\nX-A: 2\r\n\r\n<title>T &amp; U</title><p>caf\xe9</p><script>no</script><a href='/b'>go</a>"
    rows = [("<urn:uuid:1>", "http://x.org/a", "2024-01-01T00:00:00Z", page, 1), ("<urn:uuid:2>", None, None, None, 2), (None, "http://y", None, b"", 3)]
    records = warc_derivatives.derive(spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary, title int"))
    got = records.collect()
    assert len(got) == 6
    meta, text = (next(r for r in got if r["refers_to"] == "<urn:uuid:1>" and r["warc_type"] == t) for t in ("metadata", "conversion"))
    assert meta["concurrent_to"] == text["record_id"] and text["concurrent_to"] == meta["record_id"]
    assert bytes(text["block"]).decode() == "T & U\ncafé\ngo"
    envelope = json.loads(bytes(meta["block"]))
    assert envelope["headers"][1:] == [["X-A", "1"], ["X-A", "2"]] and envelope["links"] == ["http://x.org/b"] and envelope["title"] == "T & U"
    assert envelope["source_block_digest"] == warc_derivatives.digest(page)
    members = warc_derivatives.serialised(records).collect()
    back = [r for m in members for r in warc_derivatives.members(bytes(m["member"]))]
    assert sorted(bytes(r["block"]) for r in back) == sorted(bytes(r["block"]) for r in got)
    assert all(gzip.decompress(bytes(m["member"])).startswith(b"WARC/1.1\r\n") for m in members)
    files = spark.createDataFrame([(b"".join(bytes(m["member"]) for m in members),)], "content binary")
    assert warc_derivatives.parsed(files).count() == 6
