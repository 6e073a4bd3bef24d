"""Repeated rows, null texts and empty tables of operators that work row by row."""

import public_tokenizers
import pytest

from faultmill.llm import decontaminate, langid, tokencounts, toxicity
from faultmill.llm.queries import BYTE_BPE

TEXTS = ["the cat sat on the mat and said nothing at all", None, "", "der hund liegt im garten und schläft", "12 34 ½",
         "which small river crosses the old stone town before it meets the northern sea"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de")[i % 2], "x") for i, t in enumerate(TEXTS)] * 3 + [(None, TEXTS[0], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, extra string").repartition(3)


def applied(spark, docs, name):
    path = public_tokenizers.path(BYTE_BPE)
    if name == "language":
        return langid.predict(docs, langid.fit(docs)), ("lang_pred", "score")
    if name == "toxicity":
        labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
        return toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, labels))), ("score",)
    if name in ("leaks", "no items"):
        items = [(7, TEXTS[5]), (8, None)] if name == "leaks" else []
        return decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")), ("leaks",)
    return tokencounts.attribute(docs, path), ("sections",)


@pytest.mark.parametrize("name", ["language", "toxicity", "leaks", "no items", "counts"])
def test_repeated_rows_and_no_rows(spark, docs, name):
    made, columns = applied(spark, docs, name)
    rows = made.collect()
    assert len(rows) == len(TEXTS) * 3 + 1 and all(r.extra == (None if r.doc_id is None else "x") for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(str([r[c] for c in columns]))
    assert all(len(found) == 1 for found in by_text.values())
    if name == "leaks":
        assert {r.text: [x.item for x in r.leaks] for r in rows} == {t: [7] if t == TEXTS[5] else [] for t in TEXTS}
    if name == "no items":
        assert all(r.leaks == [] for r in rows)
    if name == "counts":
        assert all(sum(s.n_tokens for s in r.sections) == 0 for r in rows if not r.text)
    empty, _ = applied(spark, docs.limit(0), name)
    assert empty.collect() == []
