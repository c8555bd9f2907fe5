from loomspan.llm.sentences import sentence_units, sentences

TEXT = "One is here. Two is there! \"Three, he said. And four.\" Five? " * 40


def test_null_and_repeated_ids_of_long_documents(spark):
    df = spark.createDataFrame([(None, TEXT), (1, TEXT), (1, TEXT), (2, "Six. " + TEXT), (3, "Short. Text.")], "doc_id long, text string")
    for run in (sentences, sentence_units):
        whole, cut = (sorted(map(repr, run(df, piece=piece).collect())) for piece in (1 << 18, 200))
        assert whole == cut and any("doc_id=None" in r for r in cut)
