import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def vocabulary():
    from tidemark.llm.queries import tokenizer_path

    return tokenizer_path("word_bpe_49k.json")


EXTRA = "size long, label int, score double, class_id long, node string, rep long, links long, kept boolean, block int, row long, shard int, ids string, place long, cell int, turn long, c string, s string, a string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, odd characters."""
    long_text = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    five = "one two three four five six seven eight nine ten eleven twelve"
    base = [
        (1, five, "en", "web"), (2, None, "en", "web"), (3, "", None, None), (4, " \t\n ", "en", None), (5, long_text, "en", "web"), (None, five, "en", "web"), (None, None, None, None),
        (7, five, "de", "book"), (7, five, "de", "book"), (8, five + " thirteen", "de", "book"), (9, "Ünïcode Ω漢字 \u0000 ​ été \u0085x  y", "fr", "web"), (10, "<|endoftext|> [UNK] </s>", "fr", "web"), (11, "mail bob.smith@mail.org or 10.1.2.3, card 4111 1111 1111 1111", "en", "code"),
        (12, "a", "en", "code"), (-13, "a", "en", "code"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, 7, 1, 0.5, 3, "n", 4, 5, True, 1, 2, 3, "i", 1, 2, 3, "c", "s", "a") for r in base]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
