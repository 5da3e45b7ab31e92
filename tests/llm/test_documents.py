"""Near copies, lines, languages and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from preciario.llm import jaccard_join, language, line_dedup, queries
from preciario.llm.components import connected
from tests.comparing import connect, differences
from tests.llm.data import AWKWARD, documents, prose
from tests.llm.test_tokens import packed_well

SF = "/root/testdata/sf0.001"


def sets_of(rows, n=3):
    out = []
    for key, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out.append((key, {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()))
    return out


def components_of(rows, share=90, n_words=3):
    sets = sets_of(rows, n_words)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * min(len(a), len(b)) >= share * max(len(a), len(b)) and 100 * len(a & b) >= share * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(key)
    low = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return sorted(((key, len(s), low[root(i)] if s else key) for i, (key, s) in enumerate(sets)), key=repr)


def edited(text, seed, n):
    words, rng = text.split(), random.Random(seed)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at] = "w%d" % rng.randrange(10**6)
    return " ".join(words)


def near_copies():
    """Groups around the threshold, chains, short texts, and texts that share a passage."""
    rows, key = [], 10
    for seed, length in enumerate((4, 8, 12, 15, 20, 24, 30, 45, 60, 120, 200, 400, 900)):
        text = prose(seed + 100, length)
        for n in range(12):
            rows.append((key, edited(text, key, n * length // 400 if length > 100 else n % 3), "en", f"s{key % 3}"))
            key += 1
        for _ in range(6):  # a chain: each is a copy of the one before
            text = edited(text, key, max(1, length // 80))
            rows.append((key, text.upper() if key % 2 else text, "en", "s"))
            key += 1
    passage = prose(7, 60)
    return rows + [(key + i, prose(500 + i, 40) + " " + passage, "en", "t") for i in range(20)]


def test_join_equals_brute_force(spark):
    rows = AWKWARD + near_copies()
    random.Random(1).shuffle(rows)
    got = sorted(map(tuple, jaccard_join.join(documents(spark, rows)).collect()), key=repr)
    assert got == components_of([r[:2] for r in rows])
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_join_of_nothing(spark):
    assert jaccard_join.join(documents(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.join(documents(spark, [(3, None, None, None)])).collect()] == [(3, 0, 3)]


def test_join_on_five_words(spark):
    rows = AWKWARD + near_copies()
    got = sorted(map(tuple, jaccard_join.join(documents(spark, rows), 80, 5).collect()), key=repr)
    assert got == components_of([r[:2] for r in rows], 80, 5)


def test_representatives_of_repeated_keys(spark):
    rows = [(1, "b c d", "x", "s"), (1, "a c d", "x", "s"), (2, "z", "x", "s"), (2, "z", "x", "t"), (None, "z", None, None)]
    got = [jaccard_join.representatives(documents(spark, r)).select("doc_id", "text", "source").collect() for r in (rows, rows[::-1])]
    assert sorted(got[0], key=repr) == sorted(got[1], key=repr)
    assert {(r.doc_id, r.text) for r in got[0]} == {(1, "a c d"), (2, "z"), (None, "z")} and len(got[0]) == 3


@pytest.mark.parametrize("dear", [False, True])
def test_every_linked_pair_shares_a_signature(dear):
    """Whatever segments the allocation leaves out: pigeonhole and one-deletion neighbourhoods."""
    rng, bands = np.random.default_rng(2), jaccard_join.Bands()
    for size in [*range(9, 60), 100, 333, 1000]:
        for trial in range(6):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            most = (2 * len(a)) * 10 // 190
            drop = int(rng.integers(0, most + 1)) if trial else most
            b = np.unique(np.concatenate([a[drop:] if trial % 2 else a[drop // 2 :], rng.integers(0, 2**63, drop // 2 if trial % 2 == 0 else 0).astype(np.uint64)]))
            if not jaccard_join.links(a, b) or np.array_equal(a, b):
                continue
            values = None
            if dear:
                costs = {(k, i): 1e9 if i % 3 == 0 else float(i) for k in set(bands.schemes(len(a)) + bands.schemes(len(b))) for i in range(bands.segments(k))}
                values = jaccard_join.allocate(costs, bands)
                for k, v in values.items():
                    assert (v + 1).sum() >= bands.differing(k) + 1 + jaccard_join.SPARE_EMPTY
            keys = [set(np.concatenate([s for _, _, s in jaccard_join.signatures(x, bands, values)]).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (size, trial)


def test_empty_one_deletion_segments_are_indexed():
    """Costs that leave out the equal segments and give value 1 to the empty ones."""
    rng, checked = np.random.default_rng(3), 0
    for size in [*range(9, 14)] * 100:
        bands = jaccard_join.Bands()
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        most = 2 * len(a) * 10 // 190
        b = np.unique(np.concatenate([a[most // 2 :], rng.integers(0, 2**63, most - most // 2).astype(np.uint64)]))
        if not jaccard_join.links(a, b) or np.array_equal(a, b):
            continue
        costs = {}
        for k in set(bands.schemes(len(a))) & set(bands.schemes(len(b))):
            m = bands.segments(k)
            parts = []
            for x in (a, b):
                segment = ((jaccard_join.mixed(x ^ jaccard_join._C) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                parts.append([set(x[segment == i].tolist()) for i in range(m)])
            costs |= {(k, i): 0.0 if not x and not y else 1e9 if x == y else 1.0 for i, (x, y) in enumerate(zip(*parts, strict=True))}
        values = jaccard_join.allocate(costs, bands)
        keys = [set(np.concatenate([s for _, _, s in jaccard_join.signatures(x, bands, values)]).tolist()) for x in (a, b)]
        assert keys[0] & keys[1], (a, b)
        checked += 1
    assert checked > 300


def test_allocation_uses_all_three_values():
    bands = jaccard_join.Bands()
    k = bands.schemes(400)[0]
    values = jaccard_join.allocate({(k, i): 1e6 if i < 8 else 1.0 for i in range(bands.segments(k))}, bands)[k]
    assert set(values.tolist()) == {-1, 0, 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(500, 501), (501, 500), (7, 7)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100), 500: 500, 501: 500}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op4_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.QUERIES["op4_jaccard_join"](spark, SF).collect()), key=repr) == components_of([tuple(d) for d in docs])


def spread_rows():
    rows = [(5000 + i, f"{prose(i, 5)}\nLicensed to all. \n{prose(i + 50, 5)}\n\n{prose(i + 90, 4)}", "en", f"s{i % 12}") for i in range(30)]
    rows += [(5100 + i, f"copied start\ncopied middle\ncopied end {i // 10}", "en", f"s{i % 15}") for i in range(30)]
    rows += [(5200 + i, f"{prose(i + 700, 5)}\nnine sites only\n{prose(i + 800, 5)}", "en", f"s{i % 9}") for i in range(27)]
    return rows + [(5300 + i, "Licensed to all.", "en", None) for i in range(3)] + AWKWARD


def test_lines_equal_oracle(spark, tmp_path):
    docs = documents(spark, spread_rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = line_dedup.remove_boilerplate(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    found = found.select("doc_id", "text", "n_lines", "n_removed").cache()
    assert differences(found, con, line_dedup.oracle()) == []
    rows = found.collect()
    assert sum(r.n_removed for r in rows) == 33
    assert all("copied middle" in r.text for r in rows if r.doc_id is not None and 5100 <= r.doc_id < 5130)
    assert all("nine sites" in r.text for r in rows if r.doc_id is not None and 5200 <= r.doc_id < 5227)
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_op7_equals_oracle(spark):
    assert differences(queries.QUERIES["op7_line_dedup"](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.ORACLES["op7_line_dedup"]) == []


def test_spread_lines(spark):
    """Frames of blank lines, blocks, copies around a line and a template of one site; a text copied to many sites stays."""
    block = "block one\nblock two\nblock three"
    rows = [(i, f"{prose(i, 5)}\n\nFramed\n\n{prose(i + 50, 5)}\n{block}\n{prose(i + 90, 5)}\nLicence", "en", f"s{i % 12}") for i in range(24)]
    rows += [(100 + i, f"copied start\nLicence\ncopied end\n{block}", "en", f"s{i % 15}") for i in range(1000)]
    rows += [(2000 + i, f"{prose(i + 2000, 5)}\ntemplate head\nFramed\ntemplate foot\n{prose(i + 4000, 5)}", "en", "s1") for i in range(300)]
    rows += [(3000 + i, f"{prose(i + 7000, 5)}\nnine sites only\n{prose(i + 8000, 5)}", "en", f"s{i % 9}") for i in range(27)]
    rows += [(None, "Licence", "en", None), (None, "Licence", None, "s1"), *AWKWARD]
    gone = {"Framed", "Licence", *block.split("\n")}
    want = []
    for key, text, _, _ in rows:
        lines = text.split("\n") if text is not None else []
        left = [x for x in lines if x not in gone]
        want.append((key, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    got = line_dedup.remove_boilerplate(documents(spark, rows).repartition(5)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert line_dedup.remove_boilerplate(documents(spark, [])).count() == 0
    staged = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, documents(spark, rows), SF).collect()}
    assert staged[100] == "copied start\ncopied end" and not any("Framed" in (x or "") for x in staged.values())


@pytest.mark.parametrize("republisher", [0, 7, 18, 19])
def test_a_site_that_republishes_all_others_changes_nothing(spark, republisher):
    """19 sites with a text each; one more site, or one of them, has all of them as well."""
    rows = [(i, f"{prose(i, 6)}\nAll rights reserved\n{prose(i + 300, 6)}", "en", f"s{i}") for i in range(19)]
    rows += [(100 + i, text, la, f"s{republisher}") for i, text, la, _ in rows]
    found = line_dedup.remove_boilerplate(documents(spark, rows)).collect()
    assert sum(r.n_removed for r in found) == 38 and all("All rights" not in r.text for r in found)


def test_copies_on_many_sites_lose_nothing(spark):
    rows = [(i, "first line here\nsecond line here\nthird line here", "en", f"s{i % 40}") for i in range(200)]
    found = line_dedup.remove_boilerplate(documents(spark, rows)).collect()
    assert sum(r.n_removed for r in found) == 0


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(n, f"line {k}", "en", f"s{n}") for k, sites in enumerate(range(5, 16)) for n in range(sites)]
    lines = line_dedup.line_rows(documents(spark, rows), "text", "source")
    want = {r.line for r in lines.groupBy("line").agg(F.count_distinct("site").alias("n")).where("n >= 10").collect()}
    assert {r.line for r in line_dedup.widespread(lines, "site", 10).collect()} == want and len(want) == 6


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 200 < len(held) < 500
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # calibrated: mean probability and accuracy agree
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held])) < 0.05


def test_language_awkward(spark):
    docs = documents(spark, AWKWARD)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(AWKWARD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred != "und" for r in got if r.doc_id not in (1, 2, 3))
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.limit(0))).collect()} == {"und"}
    unlabelled = documents(spark, [(1, "abc", None, None)])
    assert [tuple(r) for r in language.identify(unlabelled, language.train(unlabelled)).collect()] == [(1, "und", 0.0)]


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 500)
    scores = 12.0 * np.eye(3)[np.where(rng.random(500) < 0.7, labels, (labels + 1) % 3)]
    heat = language.temperature(scores, labels)
    assert heat > 5 and abs(language.softmax(scores / heat).max(axis=1).mean() - 0.7) < 0.05


def test_penalty_makes_weights_sparse():
    texts = ["the cat and the dog", "le chat et le chien"] * 20
    weights = language.fit(texts, np.array([0, 1] * 20), 2, np.ones(language.FEATURES))
    assert 0 < np.count_nonzero(weights) < 0.01 * weights.size


def test_pipeline_stages(spark):
    """Each stage on its own input, against plain Python."""
    rows = spread_rows() + near_copies() + [(9000, "12345 678", "en", "s")]
    docs = documents(spark, rows)
    (_, known), (_, lines), (_, copies), (_, packed) = corpus_pipeline.STAGES
    kept = known(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r[0] for r in rows} - {r.doc_id for r in kept.select("doc_id").collect()}
    assert gone == {1, 2, 3, 9000}
    cleaned = lines(spark, docs, SF)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert not any("Licensed" in (r.text or "") for r in cleaned.collect())
    single = copies(spark, docs, SF)
    want = {key for key, _, low in components_of([r[:2] for r in rows], corpus_pipeline.COPY_SHARE, corpus_pipeline.COPY_WORDS) if key == low or key is None}
    assert single.columns == docs.columns
    left = [r.doc_id for r in single.collect()]
    assert set(left) == want and len(left) == len(want)
    packed_well(packed(spark, docs, SF).collect(), [r[:2] for r in rows])


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got.select("doc_id").distinct().count() >= len({c for _, _, c in components_of(docs)}) - 5


def test_pipeline_as_a_whole(spark, tmp_path):
    """The packed documents are those that SQL (lines) and brute force (near copies) leave of the known ones, with their texts."""
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.known_language(spark, docs, SF).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    cleaned = [(r[0], r[1]) for r in con.execute(f"SELECT doc_id, text FROM ({line_dedup.oracle()})").fetchall()]
    stays = {key for key, _, low in components_of(cleaned, corpus_pipeline.COPY_SHARE, corpus_pipeline.COPY_WORDS) if key == low}
    packed_well(corpus_pipeline.run(spark, SF).collect(), [d for d in cleaned if d[0] in stays])
