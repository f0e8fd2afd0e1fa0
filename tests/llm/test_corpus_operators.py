"""Operators over all documents against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import decontam, line_dedup, near_dup, quality, queries, sharding
from skyledger.llm.common import table
from skyledger.llm.components import components, merged
from skyledger.llm.decontam import decontaminate
from skyledger.llm.line_dedup import TwiceFilter, segment_filter
from skyledger.session import materialize
from tests.conftest import SMALL

DOC = "doc_id bigint, text string, doc string, row int, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], DOC)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus(seed, n=120):
    """Small documents with shared lines, copies, near copies and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    lines = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.5 and rows:
            words = (rng.choice(rows)[1] or "a b c").split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = "\n".join(rng.choice([" ".join(word() for _ in range(rng.randint(1, 25))), rng.choice(lines), "  " + rng.choice(lines).upper() + "\t", passage]) for _ in range(rng.randint(1, 5)))
        rows.append((i, text))
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One  TWO")]


# Lines -----------------------------------------------------------------------


def plain_lines(rows):
    owner = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10 and i is not None:
                owner[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(owner[key(x)]) < 2 or min(owner[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("limit", [line_dedup.FILTER_BYTES, 64])
def test_lines_equal_brute_force(spark, limit):
    """Also with a filter folded far below its size: more suspects, equal results."""
    rows = corpus(1) + [(None, "some longer shared line"), (900, "Some longer shared LINE\nx"), (901, "some longer shared line\n" * 3)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(frame(spark, rows), limit).collect()}
    assert got == plain_lines(rows)


def test_lines_of_repeated_rows_long_texts_and_no_rows(spark):
    long = "\n".join(f"line number {i % 3000}" for i in range(9000))
    rows = [(1, long), (1, long), (2, "line number 7\nown text here")]
    got = line_dedup.line_dedup(frame(spark, rows))
    assert sorted((r.doc_id, r.n_dropped) for r in got.collect()) == [(1, 0), (1, 0), (2, 1)]
    assert {"row", "doc", "kept"} <= set(got.columns)
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_twice_filter_holds_all_repeats():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    once = [values[:3000].tobytes(), values[2000:].tobytes()]
    width, bits = segment_filter(once, [values[:10].tobytes(), b""])
    held = TwiceFilter(1, [(0, bits)])
    assert held.holds(values[2000:3000]).all() and held.holds(values[:10]).all()
    assert held.holds(values[10:2000]).mean() < 0.02 and len(bits) * 8 == width


# Benchmark -------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text or ""))
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in rows:
        words = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if w := windows.get(tuple(words[k : k + n])):
                    found |= w
                    hit |= set(range(k, k + n))
        out[i] = (len(words), len(hit), len(found), sorted(found), bool(hit))
    return out


def test_benchmark_hits_equal_brute_force(spark):
    rows = corpus(2)
    rng = random.Random(5)
    items = [(100, None), (101, ""), (102, "--"), (103, "zz"), (104, "one two"), (105, "a"), (106, "b b b b b b b b b b b b b b"), (9, "b " * 10)]
    for k in range(20):
        words = (rng.choice(rows)[1] or "x y").split()
        at = rng.randrange(len(words) + 1)
        items.append((k, rng.choice([", ", "\n", " "]).join(words[at : at + rng.randint(1, 30)]).upper()))
    items.append((500, items[-1][1]))
    rows += [(800, "b " * 25), (801, "c " * 9 + "b " * 13), (802, "É" * 20_000)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, digest int")
    expected = plain_hits(rows, items)
    for bits in (1 << 24, 64):  # with a full map all prints go on to the join
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate(frame(spark, rows), bench, bits).collect()}
        assert got == expected


def test_phrase_of_eight_words_in_all_texts_joins_nothing(spark, monkeypatch):
    phrase = "as far as we know at this point"
    rng = random.Random(8)
    around = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    rows = [(i, f"{around()} {phrase} {around()}") for i in range(150)]
    items = [(i, f"{around()} {phrase} {around()}") for i in range(150)]
    rows.append((999, items[3][1]))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(1000 + i, f"{around()} {passage}") for i in range(20)]
    items += [(500 + i, f"{passage} {around()}") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    written = {}

    def watch(df, name):
        written[name] = materialize(df, name)
        return written[name]

    monkeypatch.setattr(decontam, "materialize", watch)
    for bits in (1 << 24, 64):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate(frame(spark, rows), bench, bits).collect()}
        assert got == plain_hits(rows, items)
        # The copied item's windows and the 31 of the passage in 20 documents, whatever number of items holds them.
        assert written["benchmark-hits"].count() == 23 + 20 * 31
        assert written["benchmark-hits"].select("items").distinct().count() == 2


def test_given_benchmark(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    expected = {i: (a, b, c, hashlib.sha256(",".join(d).encode()).hexdigest(), e) for i, (a, b, c, d, e) in plain_hits(rows, items).items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op4_decontamination(spark, SMALL).collect()}
    assert got == expected and any(v[4] for v in got.values())


def test_benchmark_with_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "p q r"), (None, "s t u")], "item_id bigint, text string")
    rows = [(1, "p q r"), (1, "p q r"), (1, "s t u v"), (None, "p q r x"), (None, "y")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate(frame(spark, rows), bench).collect())
    assert got == [(0, 1, 0, 0), (0, 4, 3, 1), (1, 3, 3, 1), (1, 3, 3, 1), (1, 4, 3, 0)]
    assert decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(frame(spark, rows).limit(0), bench).count() == 0


# Near duplicates -------------------------------------------------------------


def plain_groups(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_groups(rows)


def test_given_near_duplicates(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_near_duplicates(spark, SMALL).collect()}
    assert got == plain_groups(rows)


def test_chain_of_near_copies_is_one_group(spark):
    """Neighbours are similar, the ends are not; also with a full map of documents."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(25)]
    for bits in (near_dup.MAP_BITS, 64):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), bits).collect()}
        assert got == {i: c for i, (_, c, _) in plain_groups(rows).items()}


def test_near_duplicates_with_null_ids_repeats_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, "lone"), (7, "a b c d e f"), (8, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True)]
    assert near_dup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_of_rows_without_ids(spark):
    """Every other row loses its id: groups are those of all rows, named by the ids that are left."""
    words = [f"w{i}" for i in range(300)]
    base = " ".join(words[:41])
    rows = [(5, base), (None, base + " x"), (None, "y " + base), (None, " ".join(words[100:140])), (None, " ".join(words[100:141])), (None, " ".join(words[100:140]))]
    rows += [(i if i % 2 else None, t) for i, t in corpus(9)]
    grouped = plain_groups([(n, t) for n, (_, t) in enumerate(rows)])
    names = defaultdict(list)
    for n, (_, component, _) in grouped.items():
        if rows[n][0] is not None:
            names[component].append(rows[n][0])
    expected = Counter()
    for n, (size, component, _) in grouped.items():
        own = rows[n][0]
        name = min(names[component]) if names[component] else None
        expected[own, size, name, own == name] += 1
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows).repartition(3)).collect())
    assert got == expected
    assert got[None, 38, 5, False] == 2  # the near copies of document 5
    assert any(k[0] is None and k[2] is None and k[3] for k in got)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(1, 30)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for i in up}
    frames = [spark.createDataFrame(part, "a bigint, b bigint") for part in (links[::3], links[1::3], links[2::3])]
    parts = merged(merged(components(frames[0]), frames[1]), frames[2])
    assert {r.node: r.component for r in parts.collect()} == got and parts.count() == len(got)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none).count() == 0 and merged(components(none), none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    made = near_dup.Circulant()
    shared, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (900, 100, 100))
    same = made.signature(np.concatenate([shared, a])) == made.signature(np.concatenate([shared, b]))
    assert abs(same.mean() - 900 / 1100) < 0.12


def test_parity_maps_never_rule_out_similar_sets():
    rng = np.random.default_rng(2)
    ruled_out = 0
    for _ in range(400):
        n, extra_a, extra_b = rng.integers(1, 400), *rng.integers(0, 120, 2)
        shared, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, extra_a, extra_b))
        maps = [near_dup.parity(np.concatenate([shared, x]))[None] for x in (a, b)]
        able = near_dup.may_be_similar(*maps, np.array([n + extra_a]), np.array([n + extra_b]))[0]
        assert able or 100 * n < 75 * (n + extra_a + extra_b)
        ruled_out += not able
    assert ruled_out > 100


# Shards ----------------------------------------------------------------------


def test_shards_hold_every_row_once_and_grow_into_the_new_one(spark):
    docs = table(spark, SMALL, "documents")
    rows = queries.op9_sharding(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 16 for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op9_sharding(spark, SMALL).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)


def test_shards_of_odd_rows(spark, tmp_path):
    # A key with more bytes than a bucket is spread over buckets, be it many short rows or a few long ones.
    rows = [(None, None), (None, "x"), (3, ""), (3, ""), (4, "y" * 10_000), (5, "z" * 800), (5, "w" * 800), (5, "v" * 800)] + [(8, "copy")] * 200
    written = sharding.write_shards(frame(spark, rows), str(tmp_path / "few"), 4, bucket_bytes=900)
    got = sharding.shard_slots(written)
    files = written.withColumn("file", F.input_file_name()).groupBy("file").agg(F.count_distinct("bucket").alias("n")).collect()
    assert files and all(r.n == 1 for r in files)  # a task holds one bucket
    out = got.collect()
    assert len({r.bucket for r in out if r["row"].doc_id == 5}) > 1 and len({r.shard for r in out if r["row"].doc_id == 5}) == 1
    assert Counter(r["row"].doc_id for r in out) == Counter(i for i, _ in rows)
    assert len({(r.shard, r.slot) for r in out}) == len(rows)
    assert len({r.shard for r in out if r["row"].doc_id == 8}) == 1
    assert len({r.bucket for r in out if r["row"].doc_id == 8}) > 1
    assert {r.crc for r in out if r["row"].text is None} == {0}
    assert sharding.shard_corpus(spark, frame(spark, rows).limit(0), 4).count() == 0


# Pipeline --------------------------------------------------------------------


def test_pipeline_stages_do_what_their_operators_say(spark):
    import corpus_pipeline as pipeline
    from skyledger.session import materialize

    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "sentencepiece"]
    good = materialize(pipeline.STAGES[0][1](spark, docs, SMALL))
    assert 0 < good.count() < docs.count() and tuple(good.columns) == pipeline.COLUMNS
    rows = [(r.doc_id, r.text) for r in good.collect()]
    lines = materialize(pipeline.STAGES[1][1](spark, good, SMALL))
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, (_, _, t) in plain_lines(rows).items()}
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    single = materialize(pipeline.STAGES[2][1](spark, lines, SMALL))
    assert {r.doc_id for r in single.collect()} == {i for i, (_, _, kept) in plain_groups(rows).items() if kept}
    rows = [(r.doc_id, r.text) for r in single.collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = materialize(pipeline.STAGES[3][1](spark, single, SMALL))
    assert {r.doc_id for r in clean.collect()} == {i for i, v in plain_hits(rows, items).items() if not v[4]}
    last = pipeline.run(spark, SMALL)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in clean.collect()}
    assert last.where(~F.col("round_trip")).count() == 0


def test_pipeline_decides_per_row(spark):
    import corpus_pipeline as pipeline

    words = [f"w{i}" for i in range(40)]
    a, near_a, b, c = " ".join(words), " ".join([*words[:39], "x"]), "six other words stand in here", "one more text of eight words to keep"
    item = table(spark, SMALL, "benchmark").where("length(text) > 200").first().text
    leak = f"before {item} after"

    def through(stage, rows):
        given = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = stage(spark, given, SMALL)
        assert tuple(got.columns) == pipeline.COLUMNS
        return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)

    def expect(rows):
        return sorted(rows, key=str)

    near = pipeline.near_duplicate_stage
    # A null id: a copy and a near copy of a named text go, of those among themselves one stays.
    assert through(near, [(5, a), (None, a), (None, near_a), (None, b), (None, b), (None, c)]) == expect([(5, a), (None, b), (None, c)])
    assert through(near, [(None, a), (None, near_a)]) in ([(None, a)], [(None, near_a)])
    # Repeated rows are one document; other texts under their id are other documents.
    assert through(near, [(7, a), (7, a), (7, a), (7, b), (8, b), (6, c), (9, near_a)]) == expect([(7, a), (7, b), (6, c)])
    assert through(near, [(1, None), (1, None), (2, ""), (None, ""), (None, "")]) == expect([(1, None), (2, ""), (None, ""), (None, "")])
    clean = pipeline.decontamination_stage
    rows = [(None, leak), (None, b), (7, leak), (7, c), (7, c), (8, None), (None, None), (9, a)]
    assert through(clean, rows) == expect([r for r in rows if r[1] != leak])


def test_pipeline_shuffles_no_text_that_surely_stays(spark):
    import corpus_pipeline as pipeline

    given = spark.range(4_000).select(F.when(F.col("id") > 9, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    rows = pipeline._with_row(given)
    gone = rows.where("text rlike '[05]7$'").select(F.col("row").alias("gone"))
    left = pipeline._without(rows, gone)
    assert sorted(left.collect(), key=str) == sorted(given.where("not text rlike '[05]7$'").collect(), key=str)
    assert pipeline._without(rows, gone.limit(0)).count() == 4_000 and pipeline._without(rows, rows.select(F.col("row").alias("gone"))).count() == 0
    # Rows that are not marked come from the scan alone, even where nothing is broadcast but the map.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pipeline._without(rows, gone)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    first = plan[plan.index("Union") :].split("\n   +-")[0]
    assert "NOT " in first and "hashpartitioning" not in first


def test_quality_rules_send_a_text_once_and_in_small_batches(spark):
    from skyledger.llm.common import BATCH_ROWS

    model = quality.QualityModel(None, float("inf"))
    rows = [(1, "word " * 60), (2, None), (3, "é " * 70), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_rules(docs, model)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(text" not in plan.replace("`", "")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert {r.doc_id: (r.n_words, r.word_chars, r.text) for r in out.collect()} == {1: (60, 240, rows[0][1]), 2: (0, 0, None), 3: (70, 70, rows[2][1]), 4: (0, 0, "")}
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    assert {r.doc_id: r.n_words for r in quality.quality_rules(binary, model).collect()} == {1: 60, 2: 0, 3: 70, 4: 0}


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    from skyledger.llm.common import BATCH_BYTES, BATCH_ROWS, map_rows, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    try:
        for value, want in (("512k", "512k"), ("64MB", str(BATCH_BYTES)), (str(64 << 20), str(BATCH_BYTES)), ("1000b", "1000b")):
            spark.conf.set(key, value)
            small_batches(spark)
            assert spark.conf.get(key) == want
        spark.conf.set(key, held)
        texts = spark.range(0, BATCH_ROWS, 1, 1).selectExpr("id", "repeat('x', 20000) as text")
        # A slice is a view of its batch: the whole buffer shows what the engine sent.
        work = lambda batch: {"bytes": [batch.column("text").buffers()[2].size], "n": [batch.num_rows]}
        sent = map_rows(texts, work, "bytes bigint, n bigint").collect()
        assert sum(r.n for r in sent) == BATCH_ROWS and max(r.bytes for r in sent) <= 2 * BATCH_BYTES
    finally:
        spark.conf.set(key, held)


def test_few_words_are_remembered_and_all_are_hashed():
    from skyledger.llm.common import CACHE_HASHES, WordHashes

    words = [b"w%d" % i for i in range(120_000)]
    cache = WordHashes()
    got = cache.of(words)
    assert len(cache) <= CACHE_HASHES <= 100_000 and (cache.of(words[:9]) == got[:9]).all() and len(set(got.tolist())) == len(words)


@pytest.mark.parametrize("most", [line_dedup.ID_BITS, line_dedup.BLOCK_BITS])
def test_marked_ids_hold_every_id(spark, most):
    ids = spark.range(0, 60_000, 7).select(F.col("id").alias("drop_doc"))
    rows = spark.range(-5, 60_000).select(F.when(F.col("id") != 3, F.col("id")).alias("doc"))
    got = {r.doc: r.may for r in line_dedup.mark_ids(rows, "doc", ids, "may", most).collect()}
    assert len(got) == 60_005 and got[None] is False
    assert all(got[i] for i in range(0, 60_000, 7))
    wrong = sum(got[i] for i in range(60_000) if i != 3 and i % 7)
    assert wrong < (6_000 if most > line_dedup.BLOCK_BITS else 20_000)
    assert not any(r.may for r in line_dedup.mark_ids(rows, "doc", ids.limit(0), "may").collect())


def test_lines_are_dropped_from_marked_documents(spark):
    rows = [(i, f"line number {i} of its own\n" + ("a line that some share" if i % 50 == 0 else f"another line {i}")) for i in range(2_000)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id: r.n_dropped for r in got.collect()}
    assert [i for i, n in kept.items() if n] == list(range(50, 2_000, 50)) and len(kept) == 2_000
