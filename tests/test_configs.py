import pytest

from pairstrand.sources import configs


def test_data_config(tmp_path):
    path = tmp_path / "set.yml"
    path.write_text("paths:\n  dump: /x\ngen_config:\n  depth: 20\n  diploid: True\n  real: False\n  seed: 5\ngen_steps:\n  parse: True\n  labels: False\ntraining:\n  a.full: 3\n  b: 1\nvalidation:\n  b: 2\n  c: 4\n")
    c = configs.read_data_config(str(path))
    assert (c.depth, c.seed, c.real, c.steps, c.paths) == (20, 5, False, {"parse": True, "labels": False}, {"dump": "/x"})
    assert c.whole == {"a.full": 3, "b": 3, "c": 4}
    path.write_text("training:\n  a: 1\nvalidation:\n")
    assert configs.read_data_config(str(path)).whole == {"a": 1}
    path.write_text("")
    assert configs.read_data_config(str(path)) == configs.DataConfig()
    for bad in ("- a\n", "training:\n  a: -1\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            configs.read_data_config(str(path))


def test_centromeres(spark, tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("chr1: [10, 20]\nchr2:\n  M: [1, 2]\n  P: [3, 9]\n")
    rows = {tuple(r) for r in configs.read_centromeres(spark, str(path)).collect()}
    assert rows == {("chr1", None, 10, 20), ("chr2", "M", 1, 2), ("chr2", "P", 3, 9)}
    path.write_text("chr1: [20, 10]\n")
    with pytest.raises(ValueError):
        configs.read_centromeres(spark, str(path))
    path.write_text("")
    assert configs.read_centromeres(spark, str(path)).count() == 0
