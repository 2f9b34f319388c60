"""The pipeline's stages against brute force on small tables with nulls, repeats and copies, and on empty ones."""

import itertools
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from paperstrata.llm import common, tokens

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, rate double, mix_source string"
LABELS = "doc_id long, quality int, toxic int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def table(corpus):
    rng_words = [w for t in (r[1] for r in corpus) for w in words(t)]
    more = [(500 + i, " ".join(rng_words[i * 70 : i * 70 + 60 + i]), "en", "ab"[i % 2], i) for i in range(30)]
    more += [(540, more[3][1].upper(), "en", "a", 1), (541, more[4][1] + " tail", "de", None, 1), (600, None, None, None, None)]
    return [(*r[:5], "id", "h", 0.5, "m") for r in [*corpus, *more]]


def stages(spark, docs, where):
    """Each stage's rows, the stages run as the driver runs them."""
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        out.append(common.stage(function(spark, out[-1], where)))
    return out


@pytest.fixture(scope="module")
def ran(spark, corpus, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows = table(corpus)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(500 + i, 1, 0) for i in range(30)] * 2 + [(500, None, 0), (None, 1, 0), (9999, 0, 1)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    return where, rows, stages(spark, common.documents(spark, where), where)


def test_columns(ran):
    _, _, out = ran
    assert [len(corpus_pipeline.STAGES), *[k for k, _ in corpus_pipeline.STAGES]] == [5, "quality_rules", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    assert all(df.columns == out[0].columns for df in out[:-1])


def good(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def test_quality_stage(ran):
    """Thirty labels certify no cutoff, so the base rules decide."""
    _, rows, out = ran
    assert {r["doc_id"] for r in out[1].collect()} == {r[0] for r in rows if good(r[1])} and out[1].count() < len(rows)


def test_exact_stage(ran):
    _, _, out = ran
    groups = defaultdict(list)
    for r in out[1].collect():
        groups[r["text"].translate(UP)].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in out[2].collect()) == sorted(map(min, groups.values())) and out[2].count() < out[1].count()


def test_near_stage(ran):
    _, _, out = ran
    sets = {}
    for r in out[2].collect():
        w = [x.translate(UP) for x in words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in out[3].collect()) == sorted(i for i in root if find(i) == i) and out[3].count() < out[2].count()


def test_mixing_stage(ran):
    _, _, out = ran
    before, after = out[3].collect(), Counter(tuple(r) for r in out[4].collect())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * after[tuple(r)]
        largest[r["source"]] = max(largest[r["source"]], n)
    assert set(after) <= {tuple(r) for r in before} and max(after.values()) <= 3
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        live = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in live) for s in order}
        if not (over := {s for s in live if target[s] > 3 * sizes[s]}):
            break
        full |= over
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)


def test_packing_stage(ran):
    _, _, out = ran
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    want, got, sequences = Counter(), Counter(), defaultdict(list)
    for r in out[4].collect():
        want[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    for r in out[5].collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_run_is_the_stages(spark, ran):
    where, _, out = ran
    assert Counter(map(tuple, corpus_pipeline.run(spark, where).drop("sequence_id", "offset").collect())) == Counter(map(tuple, out[5].drop("sequence_id", "offset").collect()))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert all(not df.collect() for df in stages(spark, common.documents(spark, str(tmp_path)), str(tmp_path)))


def test_repeated_ids(spark, ran, tmp_path):
    """Rows that repeat an id are judged by their texts; of rows that repeat both, one stays."""
    _, rows, _ = ran
    long = [r for r in rows if r[0] in (500, 501, 502)]
    spark.createDataFrame([*long, *long, (500, long[1][1] + " other words", *long[0][2:])], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = stages(spark, common.documents(spark, str(tmp_path)), str(tmp_path))
    assert [df.count() for df in out[:3]] == [7, 7, 4]
