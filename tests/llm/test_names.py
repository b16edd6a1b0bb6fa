"""Name candidates of op3."""

from mediacat.llm import pii

TEXTS = ["Dear James Smith, hello", "Mr James Smith", "Contact Maria Lopez", "für Jürgen Müller und Élodie Brûlé", "James Smith McDonald", "one word James only"]
PAIRS = [{"Dear James", "James Smith"}, {"Mr James", "James Smith"}, {"Contact Maria", "Maria Lopez"}, {"Jürgen Müller", "Élodie Brûlé"}, {"James Smith"}, set()]


def test_every_pair_of_capitalised_words_is_a_candidate(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    name = pii.KINDS.index("name")
    for r in pii.spans_of(docs).collect():
        assert {TEXTS[r.doc_id][s.start : s.end] for s in r.spans if s.no == name} == PAIRS[r.doc_id]


def test_overlapping_names_give_way_to_the_likeliest(spark):
    docs = spark.createDataFrame([(0, "Dear James Smith")], "doc_id long, text string")
    spans = pii.spans_of(docs)
    one = spans.select(pii.apart(spans["spans"], lambda s: s["v2"].cast("double")).alias("s")).first().s
    assert [(s.start, s.end) for s in one] == [(5, 16)]
    assert len(spans.first().spans) == 2
