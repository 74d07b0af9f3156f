"""Token counts of prefixes, the filter audit and phrase collocations against brute force, with their edge cases."""

import itertools
import random
import re
from collections import Counter

import pytest

from facetflow.llm import collocations, filter_audit, queries, token_counts
from tests.conftest import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n long, h1 string, part string"


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())


def test_token_counts_equal_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_prefix_token_counts"](spark, DATA)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    model = library()
    want = {(k, len(v.encode()), n := len(model.encode(v)), n > 4096) for k, v in docs.items()}
    assert {tuple(r) for r in rows.collect()} == want


def test_tokens_of_every_prefix(spark):
    rng = random.Random(5)
    parts = [*"abcehinorst .,-_()=<>/\n\t\x00019ABéèßñ🙂漢字▁　", "the", "ing", " re", "http://", "</s>", "    ", " " * 40, "." * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(120)] + ["", None, "x" * 3000, "word " * 2000, "▁", " "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    prefixes = token_counts.prefix_counts(docs)
    model = library()
    asked = [(k, c) for k, t in enumerate(texts) for c in sorted({0, 1, len(t or ""), len(t or "") + 5, *range(0, min(60, len(t or "")))})]
    got = token_counts.prefix_tokens(prefixes, spark.createDataFrame(asked, "doc_id long, chars long")).collect()
    assert {tuple(r) for r in got} == {(k, c, len(model.encode((texts[k] or "")[:c]))) for k, c in asked}
    budgets = [(k, b) for k in range(125) for b in (0, 1, 7, 30)]
    for k, b, chars, tokens in token_counts.longest_prefix(prefixes, spark.createDataFrame(budgets, "doc_id long, budget long")).collect():
        text = texts[k] or ""
        every = [len(model.encode(text[:i])) for i in range(min(len(text), 400) + 1)]
        if len(text) <= 400:
            best = max(i for i, n in enumerate(every) if n <= b)
            assert (chars, tokens) == (best, every[best])


def test_prefix_counts_of_odd_rows(spark):
    schema = "doc_id long, text string, n_tokens string, steps int"
    docs = spark.createDataFrame([(None, "a b", "x", 1), (3, "a b", "x", 1), (3, "a b", "y", 2), (4, None, None, None), (5, "", "", 0)], schema)
    rows = sorted((tuple(r) for r in token_counts.token_counts(docs, limit=1).collect()), key=str)
    assert rows == sorted([(None, 3, 2, True), (3, 3, 2, True), (3, 3, 2, True), (4, 0, 0, False), (5, 0, 0, False)], key=str)
    assert token_counts.token_counts(docs.limit(0)).collect() == []
    assert token_counts.prefix_counts(docs).where("doc_id = 4").first()["steps"] == b""


def audit_by_hand(docs, labels):
    """All orders, one after another, on lists."""
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(d[0], first.get(d[1] or "", d[0]))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and first[text] < doc_id,
        }
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, removed_in = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_in[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {(p, o, s, *v, removed_in[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_equals_all_orders_by_hand(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["one", "two", "Three", "FOUR", "x#y", "été", *map(str, range(60))])
    texts = [" \t\n".join(word() for _ in range(rng.choice([0, 5, 49, 50, 80, 200]))) for _ in range(40)] + ["", None, " \x0b ", "A" * 30, "\xa0".join("ab" * 30)]
    docs = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(150)] + [(7, texts[0], "s")] * 3
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(50)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(a, b, c, 1, 2, "z") for a, b, c in docs], "doc_id long, text string, source string, A int, good int, digest string")
    judged = spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = [tuple(r) for r in filter_audit.audit(frame, judged).collect()]
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(docs, labels)
    assert filter_audit.audit(frame.limit(0), judged).collect() == []
    assert {tuple(r)[8] + tuple(r)[7] for r in filter_audit.audit(frame, judged.limit(0)).collect()} == {0}


def test_audit_executes_each_state_once(spark):
    """31 states have edges; a state's rows are the counts of actual survivors."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = filter_audit.verdicts(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    edges = filter_audit.trie(judged, "ABCDE").toPandas()
    assert not edges.duplicated(["part", "state", "filter"]).any()
    assert set(edges.state) <= set(range(31))
    rows = judged.toPandas()
    for (state, name), found in edges.groupby(["state", "filter"]):
        alive = rows[~rows[[x for k, x in enumerate("ABCDE") if state >> k & 1]].any(axis=1)]
        assert found.removed.sum() == alive[name].sum() and found.survivors.sum() == len(alive)


def phrases_by_hand(docs, least, top):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    longest = Counter()
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longest[lang, p[i : i + k]] = max(longest[lang, p[i : i + k]], a)
    rows = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * longest[lang, p] < 80 * a:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in rows.items() for i, x in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize(("bits", "share"), [(1 << 20, 4), (64, 1 << 12)])
def test_phrases_equal_brute_force(spark, bits, share):
    rng = random.Random(11)
    vocabulary = ["a", "B", "b", "été", "ÉTÉ", "naïve", "x-y", "🙂", "c\x0bd", "the", "of", "\x1f"]
    ends = [" ", "  ", "\t", " ", ". ", ", ", "\n", " ", "!", " "]
    texts = ["".join(rng.choice(vocabulary[: rng.choice([3, 12])]) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["New York City Hall " * 40, None, "", " ,. "]
    docs = [(t, rng.choice(["en", "en", "fr", None, "und", ""])) for t in texts]
    frame = spark.createDataFrame([(k % 50, t, lang, "s", 1, "h", "p") for k, (t, lang) in enumerate(docs)], SCHEMA).repartition(5)
    got = {tuple(r) for r in collocations.collocations(frame, least=6, top=40, bits=bits, share=share).collect()}
    assert got == phrases_by_hand(docs, 6, 40)


def test_phrases_of_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(frame, bits=1 << 10).collect() == []
    frame = spark.createDataFrame([(1, None, "en", "s", 1, "h", "p")], SCHEMA)
    assert collocations.collocations(frame, bits=1 << 10).collect() == []


def test_scores_pass_64_bits(spark):
    """2000000 * a for counts of 10^13 occurrences."""
    a = 10**13
    rows = [([1], 3 * a), ([2], a + 1), ([1, 2], a)]
    got = collocations.scored(spark.createDataFrame(rows, "key array<long>, n long")).collect()
    assert [(r.key, r.a, r.l, r.r, r.score) for r in got] == [([1, 2], a, 3 * a, a + 1, 2000000 * a // (4 * a + 1))]


#: Columns with names that operators might use themselves, and a map.
CLASHING = "__size int, __key int, __k int, __low int, __more int, __copies int, __again int, __slot int, __shard int, key int, k int, size int, copies int, record int, slot int, shard int, bucket int, digest int, m map<string,int>"


def clashing(spark, rows):
    """``rows`` of (doc_id, text, lang, source, n_chars) with these columns, different in each row."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    values = [(*r, *(1000 * k + j for j in range(len(names) - 1)), {"a": k}) for k, r in enumerate(rows)]
    return spark.createDataFrame(values, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def plain(rows):
    return sorted(str({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in r.asDict().items()}) for r in rows)


def test_mixing_touches_no_column(spark):
    from facetflow.llm.mixing import mixed_documents

    docs = clashing(spark, [(k % 30 if k % 7 else None, f"word {k} " * (k % 9), "en", ["s", "t", None][k % 3], k) for k in range(90)])
    before, after = plain(docs.collect()), plain(mixed_documents(docs).collect())
    assert docs.columns == mixed_documents(docs).columns
    assert after and set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 2
    assert mixed_documents(docs.limit(0)).collect() == []


def test_shards_touch_no_column(spark, tmp_path):
    from facetflow.llm.sharding import read_shards, shuffle_into_shards, write_shards

    docs = clashing(spark, [(k % 30, f"word {k}" * (k % 5), "en", "s", k) for k in range(90)] + [(None, None, None, None, None)])
    shuffled = shuffle_into_shards(docs, shards=4)
    write_shards(shuffled, f"file://{tmp_path}/shards")
    found = read_shards(docs, f"file://{tmp_path}/shards")
    assert plain(found.select("record.*").collect()) == plain(docs.collect())
    assert sorted(r["count"] for r in found.groupBy("shard").count().collect()) == [22, 23, 23, 23]


def test_pipeline_stages_touch_no_column(spark):
    """Stages that give documents give their columns whole; nulls, repeats and an empty table go through all four."""
    import corpus_pipeline

    source = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in source] + [tuple(source[0]), (None, None, None, None, None), (5, "", "en", None, 0)]
    docs = clashing(spark, rows)
    whole = set(plain(docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns and set(plain(out.collect())) <= whole
            docs = out
    assert out.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).collect() == []
