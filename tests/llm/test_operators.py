"""Each operator on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, columns with clashing names."""

import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
COPY = " ".join(f"c{i}" for i in range(60))
NEAR = COPY.replace("c30 ", "x30 ")
TEXTS = [None, "", "  ", "one", "one two three", LONG, COPY, COPY, NEAR, COPY.replace(" ", "  "), "</s>[INST] a [/INST] <\\s> [\\\\INST]", "tie tie tie"]
DOCS = [(i, t, None if i % 4 == 3 else f"s{i % 4}") for i, t in enumerate(TEXTS)] + [(3, "one", "s3"), (3, "one", "s3"), (None, "null id here", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that clash with the operators' own names."""
    rows = [(*r, 1, 2, 3, 4) for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, block int, size int, __k int").repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("1 = 0")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_scores(docs, no_docs):
    from facetflow.llm.lm_scoring import score_documents

    got = score_documents(docs, block_bytes=1000, part_grams=500).toPandas()
    lists = [words(t) for _, t, _ in DOCS]
    counts: dict = {}
    for w in lists:
        for n in range(1, 4):
            for i in range(len(w) - n + 1):
                counts[tuple(w[i : i + n])] = counts.get(tuple(w[i : i + n]), 0) + 1
    total = sum(map(len, lists))

    def score(w):
        out = 0.0
        for i in range(len(w)):
            top = min(i + 1, 3)
            n = next((n for n in range(top, 1, -1) if counts[tuple(w[i - n + 1 : i + 1])] >= 2), 1)
            gram = tuple(w[i - n + 1 : i + 1])
            out += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + math.log(0.4) * (top - n)
        return out

    want = sorted((-1 if d is None else d, len(w), round(score(w), 6)) for (d, _, _), w in zip(DOCS, lists, strict=True))
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, round(r.score, 6)) for r in got.itertuples()) == want
    assert score_documents(no_docs).count() == 0


def test_mixing(spark, docs, no_docs):
    from facetflow.llm.mixing import mix, mixed_documents

    got = mix(docs, fan=4).toPandas()
    assert len(got) == len(DOCS)
    assert got.copies.between(0, 2).all()
    sizes: dict = {}
    for _, t, s in DOCS:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = dict(zip(order, (3, 1, 2) * 2, strict=False))
    targets, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:  # the excess of what is full is shared again
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            targets |= share
            break
        targets |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    for source, part in got.groupby(got.source.fillna("-")):
        key = None if source == "-" else source
        assert part.target.iloc[0] == pytest.approx(targets[key])
        assert abs((part["size"] * part.copies).sum() - targets[key]) <= max(part["size"].max(), 1)
    again = mix(docs.repartition(5), fan=4).toPandas()
    key = ["doc_id", "source", "size", "copy", "copies"]
    assert sorted(map(str, again[key].values.tolist())) == sorted(map(str, got[key].values.tolist()))
    assert mix(no_docs).count() == 0
    many = mixed_documents(docs, fan=4)
    assert many.columns == docs.columns
    assert many.count() == got.copies.sum()
    assert many.select("text").toPandas().text.map(lambda t: len(words(t))).sum() == (got["size"] * got.copies).sum()


def test_mixing_keeps_expectations_and_totals(spark):
    from facetflow.llm.mixing import mix

    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 23), "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string")
    taken = []
    for seed in range(5):
        got = mix(docs, seed=seed, fan=8).toPandas()
        for _, part in got.groupby("source"):
            assert abs((part["size"] * part.copies).sum() - part.target.iloc[0]) <= 23
        taken.append(got.sort_values("doc_id").copies.to_numpy())
    assert len({tuple(t) for t in taken}) == 5


VECTORS = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]


def vector_rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, 4))
    x = centre[rng.integers(0, 6, n)] + 0.08 * rng.standard_normal((n, 4))
    x[10:20] = x[5]
    rows = [(i, [float(v) for v in r.astype(np.float32)], int(i % 2)) for i, r in enumerate(x)]
    rows += [(1000 + k, v, 0) for k, v in enumerate(VECTORS)] + [(2000, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], 1)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(*r, 1, "x") for r in vector_rows()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, vector string").repartition(4)


def test_embedding_dedup(vectors):
    from facetflow.llm.embedding_dedup import near_duplicates

    rows = vector_rows()
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v for _, v, _ in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([g[2] for g in good])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    ids = np.array([g[0] for g in good])
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low, 10**9).min(1))
        new = np.array([new[ids == i].min() for i in ids])
        if (new == low).all():
            break
        low = new
    want = sorted((int(i), int(n), int(c)) for i, n, c in zip(ids, near.sum(1), low, strict=True))
    for block in (1024, 7):
        got = near_duplicates(vectors, codes=3, block=block).toPandas()
        assert len(got) == len(rows)
        part = got[got.vec_id.isin(ids) & got.vec_id.notna()]
        assert sorted(zip(part.vec_id.astype(int), part.n_links, part.component_id.astype(int), strict=True)) == want
        rest = got[~got.vec_id.isin(ids)]
        assert (rest.n_links == 0).all() and rest.kept.all()
    assert near_duplicates(vectors.where("1 = 0")).count() == 0


def test_multi_index_meets_every_link():
    """Near copies along the gap of two centroids, none of them in the sample: of each pair one sees the other's cell."""
    from facetflow.llm.embedding_dedup import MultiIndex
    from facetflow.llm.vectors import unit

    rng = np.random.default_rng(1)
    index = MultiIndex(unit(rng.standard_normal((2000, 32))), 8, 0.98)
    a = unit(rng.standard_normal((4000, 32)))
    gap = index.books[0][rng.integers(0, 8, 4000)] - index.books[0][rng.integers(0, 8, 4000)]
    b = unit(a + np.pad(0.19 * gap / np.maximum(np.linalg.norm(gap, axis=1, keepdims=True), 1e-9), ((0, 0), (0, 16))))
    linked = (a * b).sum(1) >= 0.98
    own_b = index.cells(b)[0]
    own_a, row, cell = index.cells(a)
    seen = set(zip(row.tolist(), cell.tolist(), strict=True))
    apart = np.flatnonzero(linked & (own_a != own_b))
    assert len(apart) > 100
    assert all((k, own_b[k]) in seen for k in apart.tolist())


def test_graph_search(vectors):
    from facetflow.llm.ann import build_index, search, usable

    v = usable(vectors)
    got = search(build_index(v, shard=100), v.where("vec_id % 50 = 0"), k=4).toPandas()
    rows = [(i, np.array(x, float)) for i, x, _ in vector_rows() if i is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    hits = 0
    for query, part in got.groupby("query_id"):
        dist = np.sqrt(((x - x[ids == query][0]) ** 2).sum(1))
        dist[ids == query] = np.inf
        best = ids[np.lexsort((ids, dist))[:4]]
        part = part.sort_values("rank")
        assert query not in part.vec_id.tolist()
        hits += (best == part.vec_id.to_numpy()).sum()
    assert hits >= 0.95 * len(got)
    empty = usable(vectors.where("1 = 0"))
    assert search(build_index(empty), empty).count() == 0


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<", "[", "\\", "\n", "é", "s>", "INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROL), max_size=12).map("".join))
def test_escape_is_reversible(text):
    import pyarrow as pa

    from facetflow.llm.chat import _MARK, escape, parse, unescape

    escaped = escape(pa.array([text]))[0].as_py()
    assert unescape(escaped) == text
    assert not _MARK.search(escaped)
    for role, formatted in (("user", f"<s>[INST]{escaped}[/INST]</s>"), ("system", f"<s><<SYS>>{escaped}<</SYS>></s>"), ("assistant", f"<s>{escaped}</s>"), ("x", f"<s>[ROLE]x[/ROLE]{escaped}</s>")):
        assert parse(formatted * 2) == [(role, text)] * 2


def test_chat(spark):
    from facetflow.llm import chat

    rows = [(c, t, r, x, 5) for c in (1, 2, None) for t, (r, x) in enumerate([("system", None), ("user", "</s>[INST] ok [/INST]"), ("assistant", "yes é" * 50), (None, ""), ("tool<s>", "x"), ("assistant", "yes é")])]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} <s>", 5) for k in range(400)] + [(1, 0, "system", None, 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    old = chat.PART_BYTES
    chat.PART_BYTES = 300
    try:
        got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    finally:
        chat.PART_BYTES = old
    assert len(got) == 4
    for conv in (1, 2, None, 7):
        mine = sorted((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.format_conversations(turns.where("1 = 0"))).count() == 0


def test_toxicity_edges(spark, docs, no_docs):
    from facetflow.llm import toxicity

    labels = spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(9)] + [(3, None, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, toxicity.judged(labels))
    got = toxicity.score(docs, chain).toPandas()
    assert len(got) == len(DOCS) and got.p_toxic.between(0, 1).all()
    assert toxicity.score(no_docs, chain).count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    none = toxicity.train(docs, toxicity.judged(labels.where("1 = 0")))
    assert not toxicity.score(docs, none).toPandas().toxic.any()
    assert toxicity.without_toxic(docs, labels.where("1 = 0")).count() == len(DOCS)


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_links(rows):
    sets = [shingles(t) if d is not None else set() for d, t in rows]
    n = len(rows)
    near = [[i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 for j in range(n)] for i in range(n)]
    low = [d for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and low[j] < low[i]:
                    low[i], changed = low[j], True
    return sorted((str(rows[i][0]), str(low[i]), sum(map(bool, near[i]))) for i in range(n))


def test_jaccard_join(spark, docs, no_docs):
    from facetflow.llm.jaccard_join import choose_bands, similar_documents, without_similar

    got = similar_documents(docs).toPandas()
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), str(None if pd.isna(r.class_id) else int(r.class_id)), r.n_links) for r in got.itertuples()) == brute_links([(d, t) for d, t, _ in DOCS])
    kept = without_similar(docs)
    assert kept.columns == docs.columns
    left = kept.select("doc_id").toPandas().doc_id
    assert sorted(left.dropna().astype(int)) == [0, 1, 2, 3, 4, 5, 6, 10, 11] and left.isna().sum() == 1
    assert similar_documents(no_docs).count() == 0
    bands, rows = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_jaccard_join_of_a_large_group_in_blocks(spark):
    from facetflow.llm.jaccard_join import similar_documents

    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 120))] = f"n{rng.integers(0, 9)}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    for block in (256, 5):
        got = similar_documents(docs, block=block).toPandas()
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got.itertuples()) == want


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    from facetflow.llm.packing import pack
    from facetflow.llm.tokens import END, default_path

    tokenizer = Tokenizer.from_file(default_path())
    got = pack(docs, tiers=(64, 32, 16), step=256, flush=300).toPandas()
    want = sorted((str(d), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (END,)) for d, t, _ in DOCS)
    found, at = [], {}
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        ids = np.frombuffer(r.ids, np.uint32)
        assert len(ids) == r.length
        at.setdefault((None if pd.isna(r.doc_id) else int(r.doc_id), r.doc_tokens), []).append((r.start, tuple(ids)))
    for (doc, total), pieces in at.items():
        copies = sum(s == 0 for s, _ in pieces)
        for k in range(copies):
            ids = tuple(x for _, p in pieces[k::copies] for x in p)
            assert len(ids) == total
            found.append((str(doc), ids))
    assert sorted(found) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        assert part.length.sum() == part.window.iloc[0] and part.window.iloc[0] & (part.window.iloc[0] - 1) == 0
    assert got.groupby("step_group").length.sum().max() <= 256
    assert pack(no_docs).count() == 0


def test_sharding(spark, docs, no_docs):
    from facetflow.llm.sharding import shuffle_into_shards

    got = shuffle_into_shards(docs, shards=4, bucket_bytes=2000).toPandas()
    assert len(got) == len(DOCS)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.record) == sorted(str((d, t)) for d, t, _ in DOCS)
    counts = got.groupby("shard").slot.agg(["size", lambda s: sorted(s) == list(range(len(s)))])
    assert counts["size"].max() - counts["size"].min() <= 1 and counts.iloc[:, 1].all()
    again = shuffle_into_shards(docs.repartition(7), shards=4, bucket_bytes=2000).toPandas()
    place = lambda rows: sorted((r.shard, r.slot, str(r.record["doc_id"])) for r in rows.itertuples())
    assert place(got) == place(again)
    assert shuffle_into_shards(no_docs).count() == 0


def test_warc(spark):
    from facetflow.llm.warc import read_archive, write_archive

    long = "<p>" + "x" * 200 + "é</p>"
    rows = [(5, "u5", long), (2, "u\r\n2", long), (9, None, long), (1, "u1", "tiny"), (3, "u3", "tiny"), (4, "u4", None), (6, "u6", ""), (2, "u\r\n2", long), (None, "n", long), (8, "u8", LONG)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    archive = write_archive(pages)
    assert archive.payloads.count() == 4
    got = read_archive(archive).collect()
    want = sorted((str(p), "revisit" if h == long and p != 2 else "response", "2" if h == long and p != 2 else "None", (h or "").encode()) for p, _, h in rows)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to), bytes(r.payload)) for r in got) == want
    for r in got:
        assert bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).endswith(b"\r\n\r\n")
    assert read_archive(write_archive(pages.where("1 = 0"))).count() == 0


def test_tokens_of_columns():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from facetflow.llm.tokens import WordTokenizer, default_path

    texts = ["Hello  World's <|endoftext|> x", None, "", "é́ Σας   tab\tend", "don't 123 !?", "Hello hello"]
    ids, begin = WordTokenizer.at(default_path()).encode(pa.array(texts))
    plain = Tokenizer.from_file(default_path())
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_crc_of_ids(spark):
    row = spark.sql("SELECT crc32(X'01000000') AS c").first()
    assert row.c == zlib.crc32(np.array([1], "<u4").tobytes())


def test_shards_are_written(spark, docs, no_docs, tmp_path):
    """op9's rows come from the files of the shards; they hold every record, slots in order."""
    import pyarrow.parquet as pq

    from facetflow.llm.sharding import op9_external_shuffle, read_shards, shuffle_into_shards, write_shards

    path = str(tmp_path / "shards")
    write_shards(shuffle_into_shards(docs, shards=4, bucket_bytes=2000), path)
    want = sorted(map(repr, shuffle_into_shards(docs, shards=4, bucket_bytes=2000).select("record.*", "slot", "shard").collect()))
    got = read_shards(docs, path).select("record.*", "slot", "shard").collect()
    assert sorted(map(repr, got)) == want
    for file in tmp_path.glob("shards/shard=*/*.parquet"):
        slots = pq.ParquetFile(file).read(columns=["slot"]).column(0).to_pylist()
        assert slots == sorted(slots)
    write_shards(shuffle_into_shards(no_docs), str(tmp_path / "none"))
    assert read_shards(no_docs, str(tmp_path / "none")).count() == 0
    rows = op9_external_shuffle(spark, "/root/testdata/sf0.001")
    assert all("shard=" in f for f in rows.inputFiles()) and rows.inputFiles()


def brute_classes(rows):
    """Of rows (doc_id, text): each one's smallest doc_id reachable, and its links."""
    sets = [shingles(t) if t and d is not None else set() for d, t in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(n)]
    out = []
    for i, (d, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j), todo.append(j)
        out.append((d, min(rows[j][0] for j in reach) if d is not None else None, len(near[i]), frozenset(reach)))
    return out


def test_jaccard_join_of_repeated_ids(spark):
    """One doc_id under several texts: classes stay apart, and no unrelated text goes."""
    from facetflow.llm.jaccard_join import similar_documents, without_similar

    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b.replace("b20 ", "x ")), (4, a.replace("a20 ", "x ")), (4, c), (4, c), (5, None), (5, c.replace("c9 ", "x ")), (5, " "), (None, a), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_classes(rows)
    got = similar_documents(docs).toPandas()
    plain = lambda x: None if pd.isna(x) else int(x)
    assert sorted(map(str, ((plain(r.doc_id), plain(r.class_id), r.n_links) for r in got.itertuples()))) == sorted(str(w[:3]) for w in want)
    kept = [tuple(r) for r in without_similar(docs).collect()]
    groups = {w[3] for w in want}
    for group in groups:
        assert sum(kept.count(r) for r in {rows[k] for k in group}) == 1 or len(group) == 1
    assert len(kept) == len(groups)


def test_jaccard_join_by_shuffle(spark, docs, monkeypatch):
    """The shuffle side of the broadcast switch gives the same rows."""
    from facetflow.llm import jaccard_join

    want = sorted(map(str, jaccard_join.similar_documents(docs).drop("text_hash").collect()))
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert sorted(map(str, jaccard_join.similar_documents(docs).drop("text_hash").collect())) == want


def brute_vectors(rows):
    """Of (vec_id, vector, label): links and components, by plain loops over nodes."""
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float) / max(abs(x) for x in v)) / max(abs(x) for x in v) for _, v, _ in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    out = []
    for i in range(n):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j), todo.append(j)
        out.append((rows[i][0], len(near[i]), min(rows[j][0] for j in reach)))
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_embeddings_of_mixed_lengths_and_repeated_ids(spark, batch):
    from facetflow.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(4)
    big = [float(x) for x in 1e300 * rng.standard_normal(3)]
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (1, [0.0, 1.0], 1), (3, [0.01, 1.0], 1), (4, big, 0), (5, [2 * x for x in big], 0), (6, [7.0], 0), (7, [9.0], 0), (8, [-1.0], 0)]
    rows += [(10 + k, [float(x) for x in rng.standard_normal(3)], 0) for k in range(20)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(zip(got.vec_id, got.n_links, got.component_id, strict=True)) == sorted(brute_vectors(rows))


def test_search_of_mixed_lengths_and_doubles(spark):
    from facetflow.llm.ann import build_index, search, usable

    rng = np.random.default_rng(5)
    rows = [(k, [float(x) * 10.0 ** (300 * (k % 2)) for x in rng.standard_normal(3 if k < 40 else 5)]) for k in range(80)] + [(5, [1.0, 2.0, 3.0]), (6, [4.0])]
    v = usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = search(build_index(v, shard=15), v.where("vec_id % 10 = 0 and width > 1"), k=3, beam=50).toPandas()
    assert len(got) == 8 * 3
    for query, part in got.groupby("query_id"):
        point = np.array(rows[query][1])
        # a distance beyond the range of doubles is infinite and no candidate's
        dist = sorted((float(np.sqrt(((np.array(v) - point) ** 2).sum())), i) for i, v in rows if i != query and len(v) == len(point))
        assert part.sort_values("rank").vec_id.tolist() == [i for _, i in dist[:3]]


@pytest.mark.parametrize("codes", [None, 17])
def test_embedding_dedup_beyond_the_sample(spark, codes):
    """Near copies that differ along a few directions, far more than are sampled, and rare ones elsewhere: every link, by brute force."""
    from facetflow.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 16)) * np.array([3.0] * 2 + [1.0] * 14)
    y = x[:2000] + np.pad(rng.standard_normal((2000, 2)) * 0.4, ((0, 0), (0, 14)))  # along the directions of most variance
    z = x[2000:3980] + 0.12 * rng.standard_normal((1980, 16))
    rare = x[3980:4000] + np.pad(rng.standard_normal((20, 1)), ((0, 0), (15, 0)))  # along one that few links take
    x = np.concatenate([x, y, z, rare])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    docs = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), int)})).repartition(4)
    got = near_duplicates(docs, codes=codes, sample=1000).toPandas().set_index("vec_id").n_links
    assert (got.sort_index().to_numpy() == near.sum(1)).all() and near.sum() > 3000
    if codes:  # a stop that is measured
        got = near_duplicates(docs, codes=codes, sample=1000, queries=600, recall=0.999).toPandas().set_index("vec_id").n_links
        assert (got.sort_index().to_numpy() <= near.sum(1)).all() and got.sum() >= 0.98 * near.sum()


def test_fewer_codes_where_cells_are_not_apart():
    from facetflow.llm.embedding_dedup import _index

    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = _index(unit(rng.standard_normal((2000, 64))), 64, 0.98)
    apart = _index(unit(10 * np.repeat(rng.standard_normal((64, 64)), 32, 0) + 0.05 * rng.standard_normal((2048, 64))), 64, 0.98)
    assert len(spread.books[0]) < 12 and len(apart.books[0]) > 30


def test_graph_recall_on_full_shards(spark):
    from facetflow.llm.ann import SHARD, build_index, search, usable

    rng = np.random.default_rng(7)
    x = rng.standard_normal((2 * SHARD + 3000, 24)).astype(np.float32)
    x[5000:9000] = x[:4000] + 0.05 * rng.standard_normal((4000, 24)).astype(np.float32)
    v = usable(spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(4))
    index = build_index(v)
    assert index.count() == 3
    got = search(index, v.where("vec_id % 100 = 0")).toPandas()
    hits = 0
    for query, part in got.groupby("query_id"):
        dist = ((x.astype(float) - x[query].astype(float)) ** 2).sum(1)
        dist[query] = np.inf
        hits += len({*np.argpartition(dist, 10)[:10].tolist()} & {*part.vec_id})
    assert hits >= 0.9 * len(got) and len(got) == 10 * len(range(0, len(x), 100))


def test_step_groups(spark):
    """Every group has a step's tokens, but for one rest a task; balanced, but for one of all."""
    from facetflow.llm.packing import balanced, digests, pack, packed_digests

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 99, int(rng.lognormal(3, 1.5))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = digests(pack(docs, tiers=(64, 32, 16), step=256, flush=300)).toPandas()
    tokens = got.groupby("step_group").length.sum()
    assert (tokens > 256).sum() == 0 and (tokens < 256).sum() <= 4 and (got.groupby("sequence_id").length.sum() == got.groupby("sequence_id").window.first()).all()
    joined = packed_digests(docs, tiers=(64, 32, 16), step=256, flush=300).toPandas()
    tokens = joined.groupby("step_group").length.sum()
    assert (tokens > 256).sum() == 0 and (tokens < 256).sum() <= 1
    assert sorted(joined.drop(columns="step_group").itertuples(index=False)) == sorted(got.drop(columns="step_group").itertuples(index=False))
    assert balanced(digests(pack(docs.where("1 = 0")))).count() == 0


def test_sharding_equals_a_plain_shuffle(spark):
    """Against a loop over sorted rows; ids that repeat without end go to many buckets."""
    from pyspark.sql import functions as F

    from facetflow.llm.sharding import SEED, shuffle_into_shards

    rows = [(7 if i % 3 else None if i % 2 else i, f"{i} " * 200) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = -(-total // 50_000)
    keys = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(buckets)).alias("b"), F.xxhash64(F.lit(SEED + 1), "doc_id").alias("h"), F.xxhash64(F.struct("doc_id", "text")).alias("g"))
    want, order = [], []
    found = sorted((r.b, r.h, r.g, r.doc_id, r.text) for r in keys.collect())
    for b in range(buckets):
        here = [r for r in found if r[0] == b]
        order += [here[k] for k in np.random.Generator(np.random.PCG64([SEED, b, 0])).permutation(len(here))]
    assert len({r[0] for r in found if r[3] == 7}) == buckets
    for place, r in enumerate(order):
        shard = place * 4 // 300
        want.append((shard, place - -(-shard * 300 // 4), r[3], r[4]))
    got = shuffle_into_shards(docs, shards=4, bucket_bytes=50_000).collect()
    assert sorted(((r.shard, r.slot, r.record.doc_id, r.record.text) for r in got), key=str) == sorted(want, key=str)


def test_parts_lie_over_one_buffer():
    """The column of formatted parts is the assembled buffer itself; spans and offsets fit the template."""
    from facetflow.llm import chat

    seen = {}
    real = chat._assemble
    rows = pa.record_batch({"conv_id": pa.array([1, 1, None, None, 2]), "turn": pa.array([0, 1, 0, 1, 0]), "role": ["user", "assistant", "", "tool<s>", "assistant"], "text": ["a", "b</s>é", "", "x", "zz"]})

    def watched(*args):
        seen["out"], ends = real(*args)
        return seen["out"], ends

    class Context:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    old = chat._assemble, chat.TaskContext
    chat._assemble, chat.TaskContext = watched, type("T", (), {"get": staticmethod(Context)})
    try:
        (batch,) = chat._formatted([rows])
    finally:
        chat._assemble, chat.TaskContext = old
    column = batch.column("formatted")
    assert column.buffers()[2].address == seen["out"].ctypes.data
    assert column.to_pylist() == ["<s>[INST]a[/INST]</s><s>b<\\/s>é</s>", "<s>[ROLE][/ROLE]</s><s>[ROLE]tool<\\s>[/ROLE]x</s>", "<s>zz</s>"]
    spans = [[t[a:b] for a, b in zip(x, y, strict=True)] for t, x, y in zip(column.to_pylist(), batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist(), strict=True)]
    assert spans == [["b<\\/s>é"], [], ["zz"]]
    assert batch.column("conv_id").to_pylist() == [1, None, 2] and batch.column("part").to_pylist() == [(3 << 32) + k for k in range(3)]


def test_mixing_of_rows_without_ids(spark):
    """Rows of one id or none spread by their texts; equal rows take whole numbers of copies that sum as the mix says."""
    from facetflow.llm.mixing import mix, mixed_documents

    rows = [(None, "one two", "a"), (None, "two one", "a"), (7, "one two", "a"), (7, "six seven", "a"), *[(None, "same again", "b")] * 5, (None, None, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mix(some).toPandas()
    assert len(copies) == len(rows)
    taken = [tuple(r) for r in mixed_documents(some).collect()]
    assert len(taken) == copies.copies.sum() and {*taken} <= {*rows}
    assert taken.count((None, "same again", "b")) == copies[copies.source == "b"].copies.sum()
    assert sorted(map(str, taken)) == sorted(str(tuple(r)) for r in mixed_documents(some.repartition(3)).collect())


def test_chain_equals_a_plain_loop_over_folds():
    """Out-of-fold log-odds of the first category, by models that never saw the row, are the second's last feature."""
    from facetflow.llm import toxicity

    rng = np.random.default_rng(3)
    x = rng.random((120, 4))
    y = np.column_stack([x[:, 0] + 0.2 * rng.random(120) > 0.6, x[:, 1] > 0.5]).astype(float)
    chain = toxicity.fit_chain(np.arange(4, dtype=np.uint64), x, y, folds=4, seed=5)
    fold = np.random.default_rng(5).permutation(120) % 4
    width = x
    for k in range(2):
        odds = np.array([np.nan] * 120)
        for i in range(120):
            w = toxicity.fit_logistic(width[fold != fold[i]], y[fold != fold[i], k])
            odds[i] = min(12, max(-12, float(sum(a * b for a, b in zip(width[i], w[:-1])) + w[-1])))
        assert np.allclose(1 / (1 + np.exp(-odds)), chain.out_of_fold[:, k])
        assert np.allclose(chain.weights[k], toxicity.fit_logistic(width, y[:, k]))
        width = np.column_stack([width, odds])


def test_training_on_repeated_ids(spark):
    """Of a doc_id's rows one is trained on, whatever their order and number."""
    from facetflow.llm import toxicity

    words = ["calm", "kind", "vile", "foul"]
    rows = [(i, f"{words[i % 4]} {words[(i + 2) % 4] if i % 3 else 'plain'} text {i % 5}") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(80)], "doc_id long, toxic long")
    docs = spark.createDataFrame(rows + [(3, "another text of three")] * 50, "doc_id long, text string")
    one, two = (toxicity.train(d, labels, ("toxic",)) for d in (docs, docs.repartition(7)))
    assert len(one.out_of_fold) == 80
    assert np.array_equal(one.features, two.features) and all(np.array_equal(a, b) for a, b in zip(one.weights, two.weights))
