"""Packing, the Merkle manifest and the clustering against brute force, with their edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm import bins, centroids, merkle, packing, queries
from skyledger.llm.common import table
from tests.conftest import SMALL

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, rank int, length string"

ODD_TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "It's we'll I'D 'S ''s can't", "Ünïcode é à ﬁ Å Ａ", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "12 345 a1b2 $$$ !?# a.b,c", "\x00\x01 nul \x7f", "İ ß Σας", "日本語テキスト と 한국어", "é ́x", "x" * 5000, "word " * 5000, "a_b-c <| |> <|x", "ÀÉß straße ÿ Ÿ ×÷ ñ'S É's ÖÄÜöäü1é2 ¡¿ ªº", "".join(map(chr, range(33, 1500))), " ".join(map(chr, range(33, 1500))), "👩‍👩‍👧 🎉🎉",
]


def documents(seed=1, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéAB.,'1") for _ in range(rng.randint(1, 8)))
    texts = ODD_TEXTS + [" ".join(word() for _ in range(rng.choice([1, 5, 60, 300, 900]))) for _ in range(n - len(ODD_TEXTS))]
    rows = [(i * 7 % 400, t, rng.choice([None, "en", "en", "en", "", "dé", "zz"]), rng.choice([None, "s", "é"]), rng.choice([None, i]), 1, 2, "x") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "no id", "en", None, None, 1, 2, "x"), (None, "no id", "en", None, None, 1, 2, "x"), (7, "Other Text", "en", "s", 3, 1, 2, "x"), (999, "Alone", "only", "s", 1, 1, 2, "x")]


# Packing -----------------------------------------------------------------------


def fewest_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest_bins():
    rng, better = random.Random(3), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(max(1, capacity // 5), capacity // 2) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=capacity + 1)
        found, fewest = bins.complete_bins(counts, capacity, width=10**6, nodes=10**5), fewest_bins(items, capacity)
        assert found.bound <= fewest == found.size
        better += sum(n for _, n in bins.best_fit(counts, capacity)) > fewest
        packed = [x for runs, times in found.bins for x, n in runs for _ in range(n * times)]
        assert sorted(packed) == sorted(items) and all(sum(x * n for x, n in runs) <= capacity for runs, _ in found.bins)
    assert better  # the search beat best fit at least once


def test_completions_are_undominated_and_ordered_by_waste():
    counts = np.bincount([2, 3, 4, 6, 6], minlength=11)
    found = list(bins.completions(counts, 10, 10, 100))
    # 6+4 takes all; nothing is better than it but other full fillings.
    assert found[0] == (((6, 1), (4, 1)), 0) and [w for _, w in found] == sorted(w for _, w in found)
    assert bins.dominated(((4, 1), (2, 1)), 4, counts) and not bins.dominated(((6, 1), (4, 1)), 0, counts)
    # One item that fills the room dominates every other filling.
    assert list(bins.completions(np.bincount([2, 2, 3, 4, 7], minlength=11), 7, 7, 100)) == [(((7, 1),), 0)]


def test_bins_by_count_equal_bins_item_by_item():
    rng = random.Random(5)
    for _ in range(60):
        capacity, items = 60, [rng.randint(1, 60) for _ in range(rng.randint(1, 300))]
        rooms = []
        for item in sorted(items, reverse=True):
            fit = min((r for r in rooms if r >= item), default=None)
            if fit is None:
                rooms.append(capacity - item)
            else:
                rooms.remove(fit)
                rooms.append(fit - item)
        assert sum(n for _, n in bins.best_fit(np.bincount(items, minlength=61), capacity)) == len(rooms)


def test_word_ids_equal_the_whole_text_ids():
    whole, words = Tokenizer.from_file(packing.TOKENIZER), packing.WordIds(packing.TOKENIZER)
    for row in documents(seed=8, n=400):
        text = row[1] or ""
        assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_parts_of_words_are_encoded_once():
    class Counted:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, part):
            self.asked.append(part)
            return self.model.tokenize(part)

    whole, words = Tokenizer.from_file(packing.TOKENIZER), packing.WordIds(packing.TOKENIZER)
    words._model = counted = Counted(words._model)
    text = "river River, RIVER. (river) river's \"River\" Überfluß überfluß, über2 a<|b don''t"
    assert words.of(text.encode()) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert counted.asked.count("river") == 1
    assert len(counted.asked) == len(set(counted.asked))
    # The next task of a worker knows them too.
    assert packing.known_words(packing.TOKENIZER) is packing.known_words(packing.TOKENIZER)


def check_packing(rows, texts, capacity):
    """Pieces are the documents' ids, sequences are filled without gaps."""
    whole = Tokenizer.from_file(packing.TOKENIZER)
    expected = defaultdict(int)
    for doc_id, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            expected[(doc_id, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), math.ceil(sum(k[3] * n for k, n in expected.items()) / capacity)


def test_packing_odd_documents(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOC).repartition(5)
    for capacity in (2048, 50):
        out = packing.pack_documents(df, capacity=capacity).collect()
        used, least = check_packing(out, [r[:2] for r in rows], capacity)
        assert used <= least + 2
    kept = packing.pack_documents(df, capacity=50, keep_ids=True)
    assert kept.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    by_sequence = {r["sequence_id"]: r["ids"] for r in packing.sequences(kept).collect()}
    for r in kept.collect():
        assert by_sequence[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_query(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    used, least = check_packing(queries.op11_packing(spark, SMALL).collect(), [tuple(r) for r in docs], 2048)
    assert used == least


# Manifest ----------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_proof(levels, rank):
    steps = []
    for level in levels[:-1]:
        start = rank // 8 * 8
        run = level[start : start + 8]
        steps.append((run[: rank - start], run[rank - start + 1 :]))
        rank //= 8
    return steps


def plain_audit(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[lang] = plain_levels([leaf_of(r) for r in trees[lang]])
    top = plain_levels([built[lang][-1][0] for lang in langs])
    root, out = top[-1][0], []
    for k, lang in enumerate(langs):
        for rank, row in enumerate(trees[lang]):
            steps = plain_proof(built[lang], rank) + plain_proof(top, k)
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                changed[1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
            at = leaf_of(changed)
            for left, right in steps:
                at = sha("".join(left) + at + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in steps))
            out.append((row[0], leaf_of(row), built[lang][-1][0], root, proof, at, at == root))
    return sorted(out, key=str)


def audited(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_of_odd_documents(spark):
    rows = documents(seed=4, n=700)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got, want = audited(merkle.audit_documents(df)), plain_audit(rows)
    # Equal rows are copies: their places can be exchanged, their proofs then differ in nothing but the place.
    assert got == want
    assert {True, False} == {r[-1] for r in got}
    assert audited(merkle.audit_documents(df.limit(0))) == []
    for some in (rows[20:21], rows[20:22], rows[16:25]):
        one = spark.createDataFrame(some, DOC)
        assert audited(merkle.audit_documents(one)) == plain_audit(some)


def test_manifest_with_many_trees(spark):
    rows = [(i, f"Text {i}", f"lang{i % 83}", None, i, 1, 2, "x") for i in range(400)]
    assert audited(merkle.audit_documents(spark.createDataFrame(rows, DOC))) == plain_audit(rows)


def test_requests_for_some_places(spark):
    rows = documents(seed=6, n=300)
    leaves = spark.createDataFrame(rows, DOC).select("doc_id", "lang", merkle.text_digest(F.concat(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).alias("digest")).where("doc_id is not null")
    manifest = merkle.build_manifest(leaves, "lang", ["doc_id"])
    asked = manifest.rows.where("rank % 11 = 0").select("tree", "rank", "digest")
    unknown = spark.createDataFrame([(0, 10**6), (99, 0)], "tree bigint, rank bigint").withColumn("digest", F.lit(b"x" * 32))
    proved = merkle.prove(manifest, asked.unionByName(asked).unionByName(unknown))
    rows = proved.select("tree", "rank", (merkle.folded(F.col("digest"), F.col("path")) == merkle.in_hex(F.col("root"))).alias("right")).collect()
    assert all(r["right"] for r in rows)
    assert len(rows) == 2 * asked.count()


def test_manifest_query(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert audited(queries.op12_merkle_manifest(spark, SMALL)) == plain_audit(docs)


# Clusters ------------------------------------------------------------------------


def plain_clusters(rows, dims=64, k=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, "" if i is None else sha(f"1:{i}"), v) for i, v in kept)
    centres = [list(v) for _, _, v in named[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: min(range(len(centres)), key=lambda c: (distance(v, centres[c]), c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[assign(v)].append(v)
        for c, vs in members.items():
            centres[c] = [sum(column) // len(vs) for column in zip(*vs, strict=True)]
    out = [(i, c := assign(v), distance(v, centres[c])) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in out:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centres[c])))) for i, c, d in out), key=str)


def clustered(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


VECTOR = "vec_id bigint, embedding array<float>, label int, ids string, cluster int"


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_clusters_of_odd_vectors(spark, width):
    rng = random.Random(width)
    rows = [(i, [float(np.float32(rng.choice([rng.gauss(0, 0.2), 0.25, -0.25]))) for _ in range(64)]) for i in range(120)]
    rows += [(i + 500, rows[i][1]) for i in range(40)] + rows[:5] + [(None, rows[3][1]), (None, None), (1000, None), (1001, []), (1002, rows[0][1][:63])]
    rows += [(1003, [float("nan")] + [0.0] * 63), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [0.0] * 63), (1006, [-0.0] * 64), (1007, [3.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x", 9) for i, v in rows], VECTOR).repartition(3)
    assert clustered(centroids.cluster_vectors(df, width=width)) == plain_clusters(rows)


def test_few_vectors_none_and_too_large(spark):
    rows = [(i, [0.1 * i] * 64) for i in range(5)]
    frame = lambda r: spark.createDataFrame([(i, v, 1, "x", 9) for i, v in r], "vec_id bigint, embedding array<double>, label int, ids string, cluster int")
    assert clustered(centroids.cluster_vectors(frame(rows))) == plain_clusters(rows)
    none = centroids.cluster_vectors(frame(rows[:1]).limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster_vectors(frame([(1, [1e8] * 64)])).collect()


def test_chunks_lose_nothing(spark):
    matrix = np.random.default_rng(1).integers(-(2**27), 2**27, (300, 7)).astype(np.int32)
    for width in (1, 2, 3, 7):
        entries, codes = centroids.encode_chunk(matrix, width)
        assert (centroids.decode_chunk(entries, codes, 7, width) == matrix).all()
    rows = [(i, [float(x) for x in matrix[i] % 50]) for i in range(300)]
    numbers = centroids.whole_numbers(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 7, 1)
    chunks = centroids.encode_vectors(numbers.coalesce(1), 7, 2, chunk_rows=128).collect()
    assert [len(c["ids"]) for c in chunks] == [128, 128, 44]
    back = {i: list(v) for c in chunks for i, v in zip(c["ids"], centroids.decode_chunk(c["entries"], c["codes"], 7), strict=True)}
    assert back == {i: [int(x) for x in v] for i, v in rows}


def test_cluster_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()]
    assert clustered(queries.op13_centroids(spark, SMALL)) == plain_clusters(rows)
