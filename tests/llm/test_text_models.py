"""Language, toxicity, decontamination, main text, shards."""

import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultmill.llm import decontaminate, htmltext, langid, sharding, toxicity


def test_automaton_knows_all_substrings():
    text = " abracadabra banana "
    automaton = langid.Automaton(text)

    def laid(words):
        width = max(map(len, words))
        return np.array([[ord(c) for c in w] + [0] * (width - len(w)) for w in words])

    words = [text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)]
    assert (automaton.phrases(laid(words)) == 1).all()

    def greedy(word):
        n = 0
        while word:
            k = max([k for k in range(1, len(word) + 1) if word[:k] in text] or [1])
            word, n = word[k:], n + 1
        return n

    rng = random.Random(1)
    words = ["".join(rng.choice("abcdrnx ") for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    assert automaton.phrases(laid(words)).tolist() == [greedy(w) for w in words]


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 %% 34", "de"), (None, "x", "fr"),
                                 (-4, "the and of " * 20_000, None), (-5, "ΑΒΓ" * 100, None)], docs.schema)
    models = langid.fit(langid.training_rows(docs.union(odd)))
    got = langid.predict(docs.union(odd), models, lang="lang_pred").collect()
    found = {r.doc_id: r for r in got}
    assert [found[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and found[-1].score == 0
    assert found[-4].lang_pred == "en" and found[-5].lang_pred in models.names
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert docs.where(langid.held_out(F.col("doc_id"))).count() == len(held)


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.fit(docs)).first()
    assert (got.lang_pred, got.score) == ("und", 0)


def test_only_letters_are_letters(spark):
    """Numbers that are no digits are no letters; a language with long texts only is learned, from whole ones."""
    rows = [(i, "gleich und noch ein wort", "de") for i in range(40)] + [(100 + i, "tante belle " * 1200, "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit(docs)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "①"), (3, "¼ a"), (4, "_ 12 ४"), (5, "tante"), (6, "ª")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, models).collect()}
    assert got[1] == got[2] == got[4] == ("und", 0) and got[3][0] in ("de", "fr") and got[5][0] == "fr" and got[6][0] != "und"


def labelled(spark, n, seed):
    rng = random.Random(seed)
    syllables = ["ta", "lo", "mi", "ren", "so", "ka", "du", "vel"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["grumptious", "Blatherskite", "zounderkin"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_of_held_out_documents(spark):
    rows = labelled(spark, 1600, 1)
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxic int, score string")
    odd = spark.createDataFrame([(None, "grumptious", 1, ""), (-7, None, None, ""), (-8, "", 0, "")], table.schema)
    docs = table.union(odd)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), "toxic").union(
        spark.createDataFrame([(0, 1, 0), (123_456, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))
    model = toxicity.fit(toxicity.training_rows(docs.drop("toxic"), labels))
    made = toxicity.score(docs, model)
    assert made.columns == ["doc_id", "text", "toxic", "score"]
    got = [r for r in made.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
           and r.toxic is not None]
    flagged = [r.toxic for r in got if r.score >= 0.7]
    assert np.mean(flagged) > 0.95 and sum(flagged) > 0.9 * sum(r.toxic for r in got)
    assert all(0 <= r.score <= 1 for r in made.collect())


def test_toxic_ratios_are_kept_apart(spark):
    """Expressions that shared a slot of the old tables of 2**22: each has its own ratio, or its context's."""
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 48, 40_000, dtype=np.uint64))
    slots = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)
    order = np.argsort(slots, kind="stable")
    same = np.flatnonzero(np.diff(slots[order]) == 0)
    seen, strangers = keys[order[same]], np.setdiff1d(keys[order[same + 1]], keys[order[same]])
    assert strangers.size > 100
    rows = spark.createDataFrame([(k, float(n)) for n, k in enumerate(seen.astype(np.int64).tolist())], "gram long, ratio double")
    context = int(strangers[0]) >> 8
    rest = spark.createDataFrame([(context, -3.0)], "context long, ratio double")
    model = toxicity.Model(toxicity._collected(rows, "gram"), toxicity._collected(rest, "context"), *[np.zeros(5)] * 3)
    assert model.ratios(seen).tolist() == list(range(seen.size))
    assert model.ratios(strangers).tolist() == [-3.0 if int(k) >> 8 == context else 0.0 for k in strangers]


def test_toxic_ratios_do_not_travel_through_the_driver(spark):
    """Only file names go with a task, however many rows there are; tasks find every ratio."""
    rows = spark.range(0, 50_000, 1, 7).selectExpr("id * 5000000009 % 281474976710656 AS gram", "id / 8 AS ratio")
    model = toxicity.Model(toxicity._collected(rows, "gram"), toxicity._collected(rows.limit(0), "gram"), *[np.zeros(5)] * 3)
    assert len(pickle.dumps(model)) < 10_000

    def look(batches):
        for batch in batches:
            found = model.grams.find(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found.astype(float))], ["wanted", "found"])

    found = rows.mapInArrow(look, "wanted double, found double")
    assert found.where("wanted = found").count() == 50_000
    assert np.isnan(model.grams.find(np.array([3], np.uint64)))


def test_toxicity_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = toxicity.fit(none)
    docs = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert toxicity.score(docs, model).first().score == 0.5


def test_word_hashes_do_not_depend_on_the_batch():
    one, counts = decontaminate.word_hashes(["Hello, world", "", "x"])
    two, _ = decontaminate.word_hashes(["a b c hello", "WORLD x"])
    assert counts.tolist() == [2, 0, 1] and one[0] == two[3] and one[1] == two[4] and one[2] == two[5]


def test_common_subsequence():
    rng = random.Random(7)

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(100):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 80))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 60))]
        assert decontaminate.common_subsequence(a, b) == table(a, b)


def test_leaks_and_recall(spark, sf_dir):
    rng = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = [(r.item_id, r.text) for r in spark.read.parquet(
        "/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r.text for r in docs.limit(120).collect()]
    rows, want = [], {}
    for n, (item, text) in enumerate(items):
        words = text.split()
        for turn, share in enumerate((0, .1)):
            told = [w for w in words if rng.random() >= share]
            body = rng.choice(clean).split()
            at = rng.randrange(len(body) + 1)
            rows.append((50_000 + 2 * n + turn, " ".join(body[:at] + told + body[at:])))
            want[rows[-1][0]] = item
    rows += [(60_000, None), (60_001, ""), (60_002, "a b"), (None, items[0][1])]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "x y z " * 5), (9_999, None), (9_998, "short one")], "item_id long, text string")
    got = {r.doc_id: [x.item for x in r.leaks] for r in decontaminate.leaks(made, bench).collect()}
    assert np.mean([want[d] in got[d] for d in want]) >= 0.95
    assert got[60_000] == got[60_001] == got[60_002] == [] and got[None] == [items[0][0]]


def test_items_in_several_blocks_are_numbered_without_one_task(spark, monkeypatch):
    from faultmill.llm import common
    placed = []
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    monkeypatch.setattr(decontaminate, "numbered", lambda *a: placed.append(a[2]) or common.numbered(*a))
    items = [(n, f"alpha{n} beta{n} gamma{n}") for n in range(8)]
    docs = spark.createDataFrame([(n, f"before {t} behind") for n, t in items], "doc_id long, text string")
    made = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string").repartition(4))
    assert {r.doc_id: [x.item for x in r.leaks] for r in made.collect()} == {n: [n] for n, _ in items}
    assert placed == ["at"]


def test_leaks_of_a_dominant_item_and_of_short_ones(spark):
    """Over the fitting sample; a third of the rows are short texts with variants of one item."""
    rng = random.Random(10)
    names = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]
    item, other = rng.sample(names, 24), rng.sample(names, 20)
    short, answered = ["quo", "vadis", "domine"], ["cui", "bono"]
    rows, want = [], {}
    for n in range(4_500):
        words = rng.choices(names, k=rng.randrange(8, 30))
        if n % 3 == 0:
            words = words[:3] + [w for w in item if rng.random() > .1]
        if n % 100 == 1:
            words += other
        if n % 100 == 2:
            words += short
        if n % 100 == 4:
            words += ["quo", "domine", "vadis", *answered]
        if n % 100 == 5:
            words += [*answered, "lucro"]
        rows.append((n, " ".join(words)))
        want[n] = ({1} if n % 3 == 0 and decontaminate.common_subsequence(item, words) >= 20 else set()) | (
            {2} if n % 100 == 1 else set()) | ({3} if n % 100 == 2 else set()) | ({4} if n % 100 == 5 else set())
    bench = spark.createDataFrame([(1, " ".join(item), None), (2, " ".join(other), None), (3, "Quo vadis, domine?", None),
                                   (4, "Cui bono", "lucro"), (5, "?!", None)], "item_id long, text string, answer string")
    made = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench, answer="answer")
    got = {r.doc_id: {x.item for x in r.leaks} for r in made.collect()}
    assert {n: want[n] - got[n] for n in want if want[n] - got[n]} == {}
    assert all(got[n] <= {1} | want[n] and (n % 3 == 0 or 1 not in got[n]) for n in want)


def test_cosines_find_paraphrases_and_counts_drop_nothing(spark):
    """Every item in every document by exhaustive search; of paraphrases the cosines alone find most."""
    rng = random.Random(21)
    names = [f"{a}{b}{c}{d}" for a in "bdfgklm" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    items = {i: rng.sample(names, rng.randrange(12, 40)) for i in range(30)} | {90: ["quo", "vadis"], 91: rng.sample(names, 5)}
    rows = []
    for n in range(400):
        words, item = rng.choices(names, k=rng.randrange(30, 300)), items[n % 30]
        if n % 4 == 0:  # a paraphrase: a sixth of the words changed, some words put in, halves moved apart
            told = [w if rng.random() > 1 / 6 else rng.choice(names) for w in item]
            told = [x for w in told for x in ([w, rng.choice(names)] if rng.random() < .15 else [w])]
            at = rng.randrange(len(words))
            words[at:at] = told
        if n % 50 == 7:
            words[5:5] = items[90 + n % 2]
        rows.append((n, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: {x.item: x.cosine for x in r.leaks} for r in decontaminate.leaks(docs, bench).collect()}
    index = decontaminate.fit(docs, [(i, " ".join(w), None) for i, w in items.items()])
    want = {}
    for n, text in rows:
        own = decontaminate.word_hashes([text])[0].tolist()
        found = set()
        for i, words, answer in zip(index.item_ids, index.words, index.answers, strict=True):
            if len(words) < decontaminate.LEAST_WORDS:
                held = any(own[p:p + len(words)] == words for p in range(len(own)))
            else:
                held = any(decontaminate._verified(words, answer, own[max(0, p - len(words)):p + 2 * decontaminate.BLOCK + len(words)])
                           for p in range(0, len(own), decontaminate.BLOCK))
            found |= {i} if held else set()
        want[n] = found
    assert {n: set(g) for n, g in got.items()} == want and sum(map(len, want.values())) > 80
    long = [c for n, g in got.items() for i, c in g.items() if i < 90]
    assert np.mean(long) >= 0.9


def test_index_is_fitted_on_all_passages(spark):
    """With as many dimensions as terms the latent rows give back the inverse of A'A, A being every passage."""
    rng = random.Random(31)
    names = [f"{a}{b}{c}" for a in "bdfg" for b in "aei" for c in "lmn"]
    items = [(i, " ".join(rng.sample(names, 20)), None) for i in range(5)]
    texts = [" ".join(rng.choices(names, range(1, len(names) + 1), k=rng.randrange(4, 70))) for _ in range(5_000)]
    index = decontaminate.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), items)
    place = {decontaminate.word_hashes([name])[0][0]: name for name in names}
    place = {place[t]: k for k, t in enumerate(index.terms)}
    size = decontaminate.BLOCK
    rows = []
    for text in texts:
        words = text.split()
        rows += [words[p:p + 2 * size] for p in range(0, len(words), size)]
    own = [text.split() for _, text, _ in items]
    matrix = np.zeros((len(rows) + len(own), len(place)))
    for k, words in enumerate(rows + own):
        for word in words:
            if word in place:
                matrix[k, place[word]] += index.weights[place[word]]
    whole = matrix.T @ matrix
    np.fill_diagonal(whole, whole.diagonal() + np.trace(whole) / len(place))
    assert np.allclose(index.latent @ index.latent.T @ whole, np.eye(len(place)), atol=1e-2)


def test_variants_of_short_items(spark):
    """Items of few words are found where words were changed, left out or put in, as long ones are."""
    items = [(1, "quando carthago delenda semper esse videtur romanis"), (2, "quo vadis domine hodie")]
    docs = [(1, "ante quando carthago delenda nunc esse videtur romanis post"), (2, "quo domine mane hodie"),
            (3, "ante quando carthago fuit nunc esse post"), (4, "hodie domine vadis quo"),
            (5, "quando carthago delenda semper esse videtur romanis"), (6, "vadis verba hodie"), (7, "vadis hodie")]
    made = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: [(x.item, round(x.share, 3)) for x in r.leaks] for r in made.collect()}
    assert got == {1: [(1, 0.857)], 2: [(2, 0.75)], 3: [], 4: [], 5: [(1, 1.0)], 6: [], 7: []}


def test_answer_column(spark):
    item = "which small river crosses the old stone town before it meets the northern sea"
    docs = spark.createDataFrame([(1, item + " the answer is Wharfe"), (2, item), (3, "unrelated words only here")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(5, item, "wharfe")], "item_id long, text string, answer string")
    got = {r.doc_id: bool(r.leaks) for r in decontaminate.leaks(docs, bench, answer="answer").collect()}
    assert got == {1: True, 2: False, 3: False}


PAGES = [
    ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav>"
     "<article><h1>Head &amp; more</h1><p><b>First\n   part<br><p>Second&nbsp;part</p></article>"
     "<footer>&copy; me</footer>", "Head & more\nFirst part\nSecond part"),
    ("<body><div class='menu'>Home About</div><div id=main><p>" + "Long story here. " * 20 + "</p><p>"
     + "And more of it. " * 20 + "</p></div><div class=comments><p>" + "I disagree a lot. " * 20 + "</p></div>"
     "<form>name <input></form></body>", ("Long story here. " * 20).strip() + "\n" + ("And more of it. " * 20).strip()),
    ("<main>x<!-- <p>no</p> --><style>p{}</style><aside>ad</aside><div class='cookie-notice'>ok?</div>y</main>", "x\ny"),
    ("", ""), (None, ""), ("just text", "just text"), ("<p>", ""), ("<p>a &lt;b&gt; &#233; &unknown; c", "a <b> é &unknown; c"),
    ("<article><p>one<p>two<ul><li>three<li>four</ul></article>", "one\ntwo\nthree\nfour"),
    ("<article><p>a<script>b", "a"), ("<![if x]><article>a</article>", "a"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert htmltext.main_text(html or "") == want


def test_main_text_of_div_pages_loses_no_middle():
    long = ["Long story here and on. " * 20, "And it ends like this. " * 20]
    long = [t.strip() for t in long]
    short = [f"item {k}" for k in range(12)]
    for middle in ("<ul>" + "".join(f"<li>{t}</li>" for t in short) + "</ul>",
                   "<table>" + "".join(f"<tr><td>{t}</td></tr>" for t in short) + "</table>",
                   "".join(f"<p><b><i>{t}</i></b></p>" for t in short)):
        page = f"<body><div class=text><p>{long[0]}</p>{middle}<p>{long[1]}</p></div></body>"
        assert htmltext.main_text(page) == "\n".join([long[0], *short, long[1]])
    apart = "".join(f"<div><p>{t}</p></div>" for t in short)
    page = f"<body><div><p>{long[0]}</p></div><div>{apart}</div><div><p>{long[1]}</p></div></body>"
    assert short[5] not in htmltext.main_text(page).split("\n")


@pytest.mark.parametrize("odd", ["<![foo[x]]>", "<![ x]>", "<![>", "<![1[>", "<!foo>"])
def test_text_behind_unknown_sections_stays(odd):
    page = f"<body><div><p>{'Before it. ' * 20}</p>{odd}<p>{'Behind it. ' * 20}</p></div></body>"
    text = htmltext.main_text(page)
    assert text.startswith("Before it.") and text.endswith("Behind it.")


def test_extract_columns(spark):
    rows = [(i, html, "old", 1) for i, (html, _) in enumerate(PAGES)] + [(None, PAGES[0][0], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, url long")
    made = htmltext.extract(pages)
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in made.collect()}
    assert all(got[i].text == want and got[i].n_chars == len(want) for i, (_, want) in enumerate(PAGES))
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_smoothing_keeps_a_constant():
    assert np.allclose(htmltext.smoothed(np.full(9, 3.0)), 3.0)


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", "", None]), None if i % 50 == 0 else "é" * (i % 7)) for i in range(1003)]
    rows += [(5, "a", "x"), (5, "a", "x"), (None, "b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.shards(docs.repartition(6), 8).collect()
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    for source in ("a", "b", "c", "", None):
        parts = Counter(r.shard for r in got if r.source == source)
        whole = sum(parts.values())
        assert all(abs(parts.get(s, 0) - whole / 8) <= 2 for s in range(8))
    by_id = {r[0]: r for r in rows}
    for r in got:
        if r.doc_id not in (5, None):
            raw = (by_id[r.doc_id][2] or "").encode()
            assert (r.size, r.text_crc32, r.source) == (len(raw) + 1, zlib.crc32(raw), by_id[r.doc_id][1])
    again = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shards(docs, 8).collect() if r.doc_id != 5}
    assert again == {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in got if r.doc_id != 5}
    assert sharding.shards(docs.limit(0), 8).collect() == []
