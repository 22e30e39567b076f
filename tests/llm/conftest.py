import pytest

#: Rows that every operator on documents must take: null and empty texts, blanks, ties, repeated rows, null ids and a long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "alpha beta gamma delta epsilon zeta eta theta"),
    (6, "alpha beta gamma delta epsilon zeta eta theta"),
    (6, "alpha beta gamma delta epsilon zeta eta theta"),
    (None, "a row without a name"),
    (None, None),
    (7, " ".join(f"w{i * i % 977}" for i in range(60_000))),
    (8, "Ünï çødé ёж 漢字 \x00 \x0b 𝒳 <|endoftext|> it's"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with inner ones."""
    names = "doc_id long, text string, key long, fp long, node long, size long, item long, bin long, shard int, role int, label int, x binary, lang string, n long, chunk long"
    return spark.createDataFrame([(*r, *[None] * 13) for r in ODD], names)


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
