import pytest

#: Texts with nulls, empties, ties, repeats and signs of all kinds; ids with a null and a repeat.
PROSE = "The quick brown fox jumps over the lazy dog while seven old owls watch from the tall pine near the river bank and say nothing at all until dawn comes slowly over the hills and the mist lifts away from fields where sheep sleep"
ROWS = [
    (1, PROSE), (2, PROSE), (3, PROSE.replace("fox", "cat")), (4, "Completely other words stand here and nothing of the rest does. " * 3), (5, None), (6, ""), (7, " \n\t "), (8, "Word"), (9, "word"), (None, "no id at all"), (11, "twice"), (11, "twice"),
    (12, "a  b \n\n x<|endoftext|>y  <|endoftext|> z\n<|endoftext|>\n"), (13, "  x\u0085 y 's don't I'LL 日本語 テスト　x १२३ ½ é \t\tq\r\n"), (14, "head " + PROSE + " tail"), (15, "la " * 200), (16, ("long text of many words " + PROSE + " ") * 300), (17, " \x1f\x00é" * 5), (18, "ÀÉÎ straße ﬁ"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The rows above with columns whose names clash with those of the operators."""
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", k, None, "x", float(k)) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string, _b string, score double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")
