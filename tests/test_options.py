import pytest

from folioflow.__main__ import main
from folioflow.options import ConfigurationError, Options


def test_defaults_are_valid():
    assert Options().checked() == Options()


@pytest.mark.parametrize("changes", [
    {"agent_concurrency": 6}, {"find_concurrency": 0}, {"table_concurrency": 0}, {"agent_timeout_seconds": 0}, {"confidence_threshold": 1.1}, {"image_max_patches": True},
    {"batch_id": "a/b"}, {"batch_id": ".."}, {"layout_cache_key": "k"}, {"layout_provider": object()},
    {"pages": "5-3"}, {"pages": [1, True]}, {"pages": []}, {"layout_options": {"x": {1}}}, {"agent": 3}, {"force": 1}, {"contact_sheet_size": 0},
])
def test_bad_options(changes):
    with pytest.raises(ConfigurationError) as error:
        Options(**changes).checked()
    assert len(error.value.problems) == 1


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0
    assert "insertion_slot" in capsys.readouterr().out
    assert main(["run", "last_assistant", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["conv_id", "turn", "text"]
    with pytest.raises(SystemExit):
        main(["run", "unknown", "a", "b"])


def test_pages_and_signature():
    assert Options(pages="3,1-2").page_list() == Options(pages=[2, 1, 3, 3]).page_list() == [1, 2, 3] and Options().page_list() is None
    assert Options(table_concurrency=1, batch_id="x").signature() == Options().signature() != Options(image_render_dpi=100).signature()
