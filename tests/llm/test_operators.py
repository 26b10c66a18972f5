"""Each corpus operator against a plain version, and on rows that are odd: nulls, empty and long texts, repeats, clashing columns, no rows."""

import gzip
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from pairspan.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, mixing, secrets, simhash, toxicity, warc
from pairspan.session import fresh_path
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, set int, lines string, mix string"
KEY = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"


def words(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, 60) for _ in range(12)]
    texts = [None, "", " \t\n", "a\x1cb", *base, base[0], base[0], base[1].replace(" ", "  "), "x" * 300_000, words(rng, 20_000)]
    for b in base[2:6]:  # near copies
        w = b.split()
        w[5] = "changed"
        texts.append(" ".join(w))
    shared = words(rng, 55)
    texts += [f"{words(rng, 12)}\n{shared}\n\n{words(rng, 9)}" for _ in range(5)]
    texts += [f'deploy token = "{KEY}" now', "id 9807915762804490 end"]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "b", "a", "ä"][i % 4], len(t or ""), "l", i, "k", "m") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base[0], None, None, 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_warc", "op10_mixing"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = queries()[name](spark, SF)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want


def plain_lines(rows, similarity):
    """Lines by (document, place): gone and links, from all pairs of sets."""
    lines = []
    for d, t, *_ in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            if line.split():
                lines.append(((d is None, d or 0, k), frozenset(line.split())))
    first = {}
    for at, s in sorted(lines):
        first.setdefault(s, at)
    like = {s: [o for o in first if o != s and len(s & o) >= similarity * len(s | o) - 1e-9] for s in first}
    return {(None if at[0] else at[1], at[2]): (len(like[s]), min([first[s], *(first[o] for o in like[s])]) < at) for at, s in lines}


@pytest.mark.parametrize("tile", [4, line_dedup.TILE])
def test_line_matches_are_those_of_all_pairs(docs, rows, tile):
    got = {(r.doc_id, r.line): (r.links, r.gone) for r in line_dedup.line_matches(docs, tile=tile).collect()}
    assert got == plain_lines(rows, 0.8)


def test_line_stage_cuts_lines_and_keeps_columns(docs):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert 16 not in by and by[0].text is None and by[1].text == ""
    assert len(by[25].text.split("\n")) == 4 and len(by[26].text.split("\n")) == 3 and by[26].n_chars == len(by[26].text)


def test_decontamination_finds_edited_copies_only(spark, docs, none):
    rng = random.Random(9)
    item = words(rng, 40)
    edited = item.split()
    edited[7], edited[20] = "other", "words"
    del edited[30]
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, "too short", ""), (3, None, ""), (4, words(rng, 150), "")], "item_id long, text string, score string")
    more = spark.createDataFrame([(100, words(rng, 500) + " " + " ".join(edited).upper() + " " + words(rng, 500)), (101, item), (102, words(rng, 300)), (None, item)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(more, items).collect()}
    assert set(got) == {(100, 1), (101, 1)} and got[101, 1] == 1 and 0.7 < got[100, 1] < 1
    assert {r.doc_id for r in decontaminate.drop_contaminated(more, items).collect()} == {102, None}
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_decontamination_folds_case_of_all_scripts(spark):
    """Copies in upper case, between typographic marks and inside a run of an unspaced script are found whole."""
    texts = [
        "Déjà vu à l’été où chaque élève préféré écrit une phrase légère près du château",
        "Съешь же ещё этих мягких французских булок да выпей чаю вместе со всеми друзьями",
        "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και τους παλιούς φίλους της μικρής πόλης",
        "die große Straße führt über süße Äpfel und weiße Füße bis zum Schloß",
        "我們在春天的早晨沿著河邊慢慢走回家",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rng = random.Random(4)
    near = lambda t: f"{words(rng, 200)} “{t}”—{words(rng, 200)}"
    copies = [near("—".join(t.upper().split())) for t in texts[:4]] + ["他說：「昨天" + texts[4] + "吃飯了」。"]
    found = decontaminate.contamination(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in found) == [(k, k, 1.0) for k in range(5)]


def test_words_of_all_scripts():
    texts = ["Straße İx", "", "a\u0301B\u0301 \u0301c", "\u0301日本語x2", "ＡＢ，ｃ", "ที่นี่", "x😀y ½"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    low, start, end, row = toxicity._spans(np.frombuffer(b"".join(data), np.uint8), offsets)
    got = [(r, "".join(map(chr, low[a:b]))) for a, b, r in zip(start, end, row.tolist(), strict=True)]
    assert got == [(0, "strasse"), (0, "i\u0307x"), (2, "a\u0301b\u0301"), (2, "c"), *((3, c) for c in "日本語"), (3, "x2"), (4, "ａｂ"), (4, "ｃ"), (5, "ที่"), (5, "นี่"),
                   (6, "x"), (6, "y"), (6, "½")]


def test_alignment_is_that_of_the_definition():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 5, (20, 9)).astype(np.uint64), rng.integers(1, 5, (20, 14)).astype(np.uint64)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        return h.max()

    assert decontaminate.align(x, y).tolist() == [plain(a, b) for a, b in zip(x, y, strict=True)]


def test_exact_duplicates_on_odd_rows(docs, rows, none):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(docs, capacity=2, max_depth=6).collect()}
    one = {r.doc_id: r for r in got.values() if r.doc_id is not None}
    assert one[16].keep_id == 4 and one[16].group_size == 4 and not one[16].kept and one[4].kept
    assert one[0].keep_id == 0 and one[1].keep_id == 0 and one[2].keep_id == 2 and one[18].keep_id == 5 and one[5].group_size == 3
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_secrets(docs, none, spark):
    found = {(r.doc_id, r.value): r for r in secrets.scan(docs).collect()}
    assert found[30, KEY].secret and found[30, KEY].score > 0.5 and not found[31, "9807915762804490"].secret
    assert secrets.scan(none).count() == 0
    alone = secrets.scan(docs.where("doc_id = 30")).collect()
    assert [(r.secret, r.score) for r in alone] == [(True, None)]


def test_candidates_of_one_word(spark):
    """Every run of a word is a candidate, also next to marks that end a run; each keeps the place of its word."""
    rows = [(1, f"keys ({KEY};0123456789abcdef0,short1) end", "a"), (2, None, None), (3, "", "a")]
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r["at"], r.value) for r in found) == sorted([(1, 1, KEY), (1, 1, "0123456789abcdef0")])


def test_secrets_without_spaces(spark):
    """The name may stand in the value's own word; short values after a name are candidates; what is uncertain is no example."""
    texts = [f"API_KEY={KEY}", f'token="{KEY}"', f"password:{KEY}", f"Authorization: Bearer {KEY}", f'{{"api_key":"{KEY}"}}', f"secret ={KEY}", f"token = {KEY}",
             "password=hunter2 x", "password: hunter2 x", f"id {KEY}", f"token of id {KEY}", f"id={KEY}"]
    found = secrets.candidates(spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, source string")).cache()
    assert sorted((r.doc_id, r.value) for r in found.collect()) == [(k, "hunter2" if k in (7, 8) else KEY) for k in range(12)]
    got = {r.doc_id: r.label for r in secrets.weak_findings(found).collect()}
    assert got == {**dict.fromkeys(range(7), 1.0), 9: 0.0, 11: 0.0}


def test_toxicity_learns_and_ignores_groups(spark):
    rng = random.Random(5)
    groups = ["women", "men"]
    rows_, labels_ = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = groups[0] if rng.random() < (0.9 if toxic else 0.3) else groups[1]  # named together with insults more often
        rows_.append((i, f"{words(rng, 15)} {group} {words(rng, 5)}{' awful' if toxic and rng.random() < 0.7 else ''}."))
        labels_.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels_, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "women talk."), (2, "men talk."), (3, "men are awful."), (4, None)], "doc_id long, text string")

    def gap(weight):
        s = {r.doc_id: r.score for r in toxicity.score(probe, toxicity.fit(docs, labels, counterfactual=weight)).collect()}
        assert s[3] > 0.5 > s[4]
        return abs(s[1] - s[2])

    assert gap(20.0) < 0.2 * gap(0.0)


def test_toxicity_flags_do_not_depend_on_the_cap(spark):
    """Of the texts with `mild` three tenths are toxic, of those with `awful` nearly all: a fit on a third of toxic rows flags as one on all rows does."""
    rng = random.Random(6)
    rows_, labels_ = [], []
    for i in range(4800):
        kind = {0: "awful", 1: "mild"}.get(i % 16, "nice")
        rows_.append((i, f"{kind} {rng.choice(('text', 'page', 'line'))}"))
        labels_.append((i, int(rng.random() < {"awful": 0.95, "mild": 0.3, "nice": 0.0}[kind])))
    docs, labels = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(labels_, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "awful page"), (2, "mild page"), (3, "nice page")], "doc_id long, text string")
    every, capped = ({r.doc_id: r.score for r in toxicity.score(probe, toxicity.fit(docs, labels, max_rows=n)).collect()} for n in (20_000, 900))
    assert {k: v >= 0.5 for k, v in every.items()} == {k: v >= 0.5 for k, v in capped.items()} == {1: True, 2: False, 3: False}


def test_toxicity_edges(docs, none, labels):
    out = toxicity.drop_toxic(docs, labels.where("toxic = 0"))
    assert out.columns == docs.columns and out.count() == docs.count()  # nothing to learn from
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).where("score BETWEEN 0 AND 1").count() == docs.count()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("d"), "toxic")
    got = queries()["op5_toxicity"](spark, d).where("held_out").join(truth, F.col("doc_id") == F.col("d"))
    assert got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    lang = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("d"), "lang")
    got = queries()["op8_language_id"](spark, d).where("held_out").join(lang, F.col("doc_id") == F.col("d"))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_fingerprints_and_components_are_those_of_all_pairs(docs, rows, none):
    def plain(text):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [plain(t) for _, t, *_ in rows]
    group = list(range(len(fps)))
    for _ in fps:
        group = [min(group[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f, str(least[g])) for r, f, g in zip(rows, fps, group, strict=True))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in simhash.near_duplicates(docs, tile=4).collect())
    assert got == want
    kept = [r.doc_id for r in simhash.keep_representatives(docs).collect()]
    assert sorted(kept) == sorted({least[g] for g in group} - {None})
    assert simhash.near_duplicates(none).count() == 0


def test_tile_links_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 1500).astype(np.uint64)
    x[700:900] = x[100] ^ (np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64))
    node, root = simhash.links_of(np.unique(x), None, 4)
    assert len(node) == len(np.unique(x[700:900]).tolist() + [x[100]]) - 1 - int(x[100] in x[700:900]) and set(root) <= set(x)


PAGES = [
    ("<article><h1>Title</h1><p>One <b>t</b>wo &amp; three</p><p>four</article><footer>&copy; x</footer>", "Title One two & three four"),
    ("<body><div class='menu'><ul><li><a href=/>Home</a></li></ul></div><div class=\"post-content\"><p>Main text here, long enough.</p><p>More of it.</p></div>"
     "<div id=comments><p>I disagree.</p></div><div class='cookie-notice'>We use cookies</div></body>", "Main text here, long enough. More of it."),
    (None, ""), ("", ""), ("<p", ""), ("<script>var a='<p>x</p>'", ""),
]


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(i, None, h, "t") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    network = html_extract.fit(pages)
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(odd, network).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_extract.extract(odd.limit(0), network).count() == 0 and html_extract.fit(odd.limit(0)) is None


def test_forward_pass_sums_all_segmentations():
    pieces = langid.Pieces(["▁", "▁a", "a", "ab", "b", "ba"])
    p = np.array([[0], [0.1], [0.2], [0.15], [0.25], [0.2], [0.1]])
    model = langid.Model(["x"], pieces, p, np.zeros(1))
    points, start, end, _ = langid.text_words(["abab"])
    prob = dict(zip(["▁", "▁a", "a", "ab", "b", "ba"], p[1:, 0], strict=True))
    word, total = "▁abab", 0.0
    for cuts in itertools.product([0, 1], repeat=4):
        parts = "".join(c + ("|" if k < 4 and cuts[k] else "") for k, c in enumerate(word)).split("|")
        total += np.prod([prob.get(x, 0) for x in parts])
    assert np.isclose(np.exp(langid.log_probability(points, start, end, model, langid.Hasher())[0, 0]), total)


def test_language_edges(docs, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect() if r.doc_id is not None}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert got[19].lang_pred in ("en", "de") and 0 <= got[19].score <= 1
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_warc_pushdown_foreign_files_and_odd_pages(spark):
    big = "<p>" + "y" * 200_000
    odd = [(3, "http://a b/\r\nX: 1", big), (1, None, big), (2, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (1, None, big), (None, "u", big)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    n = len(big)
    assert got == sorted([("3", n, "revisit", 1), ("1", n, "response", None), ("1", n, "response", None), ("2", 0, "response", None), ("4", 0, "response", None),
                          ("5", 5, "response", None), ("6", 5, "response", None), ("None", n, "revisit", 1)])
    path = warc.write_archive(pages)
    some = warc.read_archive(spark, path, payload=False).where("warc_type = 'revisit' AND target_uri LIKE 'http%'")
    assert [r.record_id for r in some.collect()] == ["urn:page:3"]
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, 9000 * i, b"z" * 9000 * i) for i in range(4)]
    for name, pack in (("a.warc", bytes), ("b.warc.gz", gzip.compress)):
        folder = fresh_path(spark, "foreign").removeprefix("file://")
        os.makedirs(folder)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"".join(map(pack, records)))
        read = warc.read_archive(spark, folder)
        assert [len(r.payload) for r in read.orderBy("record_id").collect()] == [9000 * i for i in range(4)]
        assert [r.record_id for r in read.where("record_id = 'urn:3'").collect()] == ["urn:3"]


def test_mix_targets_and_copies(docs, none, spark):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    met = mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "mix.*").collect()
    assert all(r.target <= 3 * r.source_size + 1e-6 and r.copies <= 3 for r in met)
    parts = {r.source_size: r.target for r in met}
    assert abs(sum(parts.values()) - sum(parts)) < 1e-6
    assert out.count() == sum(r.copies for r in met) and mixing.mixed_rows(none).count() == 0


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = out
    assert all(a >= b for a, b in itertools.pairwise(sizes[:-1])) and sizes[-2] > 0.5 * sizes[0]
