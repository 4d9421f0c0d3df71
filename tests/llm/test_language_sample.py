from jsonweave.llm.langid import fit


def test_a_rare_language_is_learned_at_any_size(spark):
    rows = [(f"the word number {i} of the common tongue", "en") for i in range(4000)] + [(f"zwölf große Vögel {i}", "de") for i in range(20)]
    model = fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=50)
    assert model.langs == ["de", "en"]
    assert model.tables()[0]["vögel"] in range(len(model.rows))
    few = fit(spark.createDataFrame(rows, "text string, lang string"), sample_docs=50)
    assert (few.rows == model.rows).all()


def test_words_of_any_length_are_learned_from(spark):
    line = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈"
    model = fit(spark.createDataFrame([(line, "zh"), ("plain words", "en")], "text string, lang string"))
    assert len(line) > 40 and model.langs == ["en", "zh"]
    assert model.vector("秋收冬藏").argmax() == 1 and model.tables()[1].get("秋收冬藏") is not None
