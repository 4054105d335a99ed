"""Texts that switch between languages stay, and their words' labels can be had."""

from lodestone.llm import crf

EN, FR, DE = "the river and the mill with a boat on this water".split(), "la maison est dans le village avec une porte sur cette rue".split(), "der hund und die katze mit einem haus auf diesem berg im wald".split()


def test_clean_switching_texts_stay(spark):
    field = crf.fit([("en", EN * 4), ("fr", FR * 4), ("de", DE * 4)] * 20)
    three, half = " ".join(EN * 3 + FR * 3 + DE * 3), " ".join(EN * 3 + FR * 3)
    assert crf.Scorer(field)([three])[0].max() < 0.5  # no language holds half of it
    docs = spark.createDataFrame([(1, three), (2, half), (3, "123"), (4, None), (5, " ".join(EN))], "doc_id long, text string")
    assert sorted(r.doc_id for r in crf.keep_identified(docs, field).collect()) == [1, 2, 5]
    got = {r.doc_id: r for r in crf.identify(docs, field, spans=True).collect()}
    for i, want in ((1, [(EN, "en"), (FR, "fr"), (DE, "de")]), (2, [(EN, "en"), (FR, "fr")])):
        assert [s.lang for s in got[i].spans] == [lang for _, lang in want] and all(s.posterior > 0.9 for s in got[i].spans)
        assert [s.last - s.first + 1 for s in got[i].spans] == [3 * len(w) for w, _ in want]
    assert got[3].spans == got[4].spans == [] and crf.identify(docs, field).columns == ["doc_id", "lang_pred", "score", "shares"]


def test_unsure_words_do_not_count_as_identified(spark):
    field = crf.fit([("en", EN * 4), ("fr", FR * 4), ("de", DE * 4)] * 20)
    for x in (field.grams, field.lex, field.moves, field.start):
        x[:] = 0  # a field that knows nothing: each word has a third
    docs = spark.createDataFrame([(1, " ".join(EN))], "doc_id long, text string")
    assert crf.keep_identified(docs, field).count() == 0
