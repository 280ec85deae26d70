import numpy as np
import pytest

from inkgrid.__main__ import main
from inkgrid.config import SettingError, Settings
from inkgrid.sources.images import encode

ENV = {"INKGRID_SOURCE_LANGUAGE": "ja", "INKGRID_TARGET_LANGUAGE": "en", "INKGRID_OUTPUT_DIR": "out"}


def test_settings():
    s = Settings.load(ENV)
    assert (s.source_language, s.min_quality, s.inpainter) == ("ja", 0.25, "none")
    for bad in ({"INKGRID_MIN_QUALITY": "1.5"}, {"INKGRID_MIN_QUALITY": "x"}, {"INKGRID_OUTPUT_DIR": " "}, {"INKGRID_OUTPUT_FORMAT": "gif"}):
        with pytest.raises(SettingError):
            Settings.load(ENV | bad)


def test_cli(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("INKGRID_OUTPUT_DIR", raising=False)
    assert main(["--dir", str(tmp_path)]) == 1
    for k, v in (ENV | {"INKGRID_OUTPUT_DIR": str(tmp_path / "out")}).items():
        monkeypatch.setenv(k, v)
    (tmp_path / "in").mkdir()
    assert main(["--dir", str(tmp_path / "in")]) == 1
    assert main(["--file", str(tmp_path / "none.png")]) == 1
    (tmp_path / "in" / "a.png").write_bytes(encode(np.full((9, 9, 3), 255, np.uint8)))
    assert main(["--dir", str(tmp_path / "in")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).select("name").collect()[0][0] == "a.png"
