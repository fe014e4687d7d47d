import pytest
from pyspark.sql import Row

PLAIN = (
    "The quick brown fox jumps over the lazy dog and runs into the deep forest where it meets a bear that sleeps "
    "under an old oak tree near the river bank in spring."
)


@pytest.fixture(scope="session")
def edge_texts():
    """By id: null, empty, blank, short, long, copied and nearly copied texts."""
    long = " ".join(f"w{i % 4001}x{i // 4001}" for i in range(40_000))
    near = PLAIN * 4
    return {
        1: PLAIN, 2: None, 3: "", 4: " \n\t \n", 5: "one", 6: PLAIN, 7: long, 8: long + " tail", 9: near,
        10: near.replace("lazy", "idle", 1), 11: "one", 12: "MIT License\nÉcole MIT-License apache  LICENSE", 13: "a\nb\nb\n\n \nb",
        14: PLAIN + "\n" + PLAIN + "\n" + PLAIN, 15: "    naïvé 😀 <|endoftext|>", 16: "x" * 100_000,
    }


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """With repeated rows, a null id, null sources and columns named like the operators' own."""
    rows = [
        Row(doc_id=i, text=t, lang=None, source=None if i % 5 == 0 else f"s{i % 4}", n_chars=None, id="x", version=i, row=0, text_=t,
            n_words="no", kept="no", _row=1, place=2, size=3)
        for i, t in edge_texts.items()
    ]
    rows.append(rows[0])
    rows.append(Row(**{**rows[8].asDict(), "doc_id": None}))
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, id string, version long, row int, text_ string, "
        "n_words string, kept string, _row int, place int, size int"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def plain_texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
