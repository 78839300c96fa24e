"""Uploads with nothing to read, and lines numbered across formats."""

import pytest

from flotilla.sources import files


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_empty_folder_is_an_empty_upload(spark, tmp_path, fmt):
    folder = tmp_path / fmt
    folder.mkdir()
    df = files.read_upload(spark, str(folder), fmt)
    assert df.count() == 0 and df.columns[:2] == ["archivo", "fila"]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_upload(spark, str(tmp_path), "xlsx")
