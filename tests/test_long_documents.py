"""Documents read as lines give the chunks of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from parapet.operators.documents import chunk_documents
from parapet.operators.long_documents import chunk_lines, read_document_lines
from parapet.sources.documents import read_documents


@pytest.mark.parametrize("size,overlap", [(500, 50), (30, 5), (60, 59), (25, 0)])
def test_lines_give_the_chunks_of_whole_files(spark, tmp_path, size, overlap):
    rnd = random.Random(size)
    for i in range(5):
        lines = [
            " ".join(rnd.choice(["a", "# b", "**c**", "[d](http://e)", "é", "f.", ""]) for _ in range(rnd.choice([0, 1, 9, 200])))
            for _ in range(rnd.choice([1, 40]))
        ]
        (tmp_path / f"f{i}.md").write_text(rnd.choice(["\n", "\r\n"]).join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = read_document_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3  # files are split
        got = chunk_lines(lines, chunk_size=size, overlap=overlap)
        got = {(r.path.rsplit("/")[-1], r.chunk_no): (r.chunk, r.n_words) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = chunk_documents(read_documents(spark, str(tmp_path)), chunk_size=size, overlap=overlap)
    want = {(r.source, r.chunk_no): (r.chunk, r.n_words) for r in whole.collect()}
    assert got == want and len(want) > 4


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], "path string, block long, at long, line string")
    assert chunk_lines(none).collect() == []
    blank = spark.createDataFrame([("p", 0, 0, ""), ("p", 0, 1, None)], none.schema)
    assert chunk_lines(blank).collect() == []
    with pytest.raises(ValueError):
        chunk_lines(none, chunk_size=5, overlap=5)
