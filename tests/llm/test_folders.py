import public_tokenizers
import pytest
from fixtures import documents

from tribunal.llm.common import qualified, store_of
from tribunal.llm.records import read_record, read_records, write_records
from tribunal.llm.warc import chunk_table, read_archives, records, write_archives

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_folders_are_resolved_once(spark, tmp_path):
    whole = f"file://{tmp_path}/x"
    for given in (f"{tmp_path}/x", f"file:{tmp_path}/x", f"file://{tmp_path}/x"):
        assert qualified(spark, given) == whole
    assert store_of(whole)[1] == store_of(f"{tmp_path}/x")[1] == f"{tmp_path}/x"
    assert qualified(spark, "s3a://bucket/a b") == "s3a://bucket/a b"
    for refused in ("ftp://host/x", "nothing:/x", "abfss://c@a/x"):
        with pytest.raises(ValueError):
            qualified(spark, refused)


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_files_are_written_and_read_below_any_form(spark, tmp_path, form):
    docs = documents(spark, [(i, f"text {i}", "en", "a", 1) for i in range(20)], clashing=False)
    files = write_records(docs, WORD, folder=form.format(tmp_path / "r"))
    assert read_records(spark, files).count() == 20
    one = files.index.where("key = 7").first()
    assert read_record(files.folder, one.file, one.offset)[0] == 7
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 40) for i in range(9)], "page_id long, url string, html string")
    archives = write_archives(chunk_table(pages), folder=form.format(tmp_path / "w"))
    assert records(read_archives(spark, archives)).count() == 9
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r", "r-index", "w", "w-manifest"]
