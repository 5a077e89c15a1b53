import os

from revgrain.sources import corpus


def test_plain_files_take_no_folder_each(spark, tmp_path):
    """Every document had a folder, a check sum and a move of its own, which took 5 ms a document."""
    rows = [(f"d{i}", f"text {i} é\n") for i in range(200)] + [("d0", "again"), ("e", None), (None, "nameless"), ("f", "")]
    folder = f"file:{tmp_path}/a b"
    corpus.write_files(spark.createDataFrame(rows, "name string, text string").repartition(3, "name"), folder)
    held = list(os.walk(tmp_path / "a b"))
    assert len(held) <= 4 and not any(f.endswith(".crc") for _, _, files in held for f in files)
    found = corpus.read_corpus(spark, folder, [".txt"]).select(corpus.file_name("path").alias("name"), "length", "text").collect()
    want = {f"d{i}": [f"text {i} é\n"] for i in range(1, 200)} | {"e": [""], corpus.NO_NAME: ["nameless"], "f": [""], "d0": ["again", "text 0 é\n"]}
    assert {r.name: sorted(r.text[:-1].split("\0")) for r in found} == want and len(found) == len(want)
    assert all(r.length == len(r.text.encode()) for r in found)


def test_names_of_files_that_spark_wrote(spark):
    paths = [("file:/x/name=d5/part-00000-1f.c000.txt",), ("file:/name=x/3/name=d7.txt",)]
    assert [r[0] for r in spark.createDataFrame(paths, "path string").select(corpus.file_name("path")).collect()] == ["d5", "d7"]
