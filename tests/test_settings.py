import pytest

from taplight.operators import detectors, settings


def test_rules_from_text():
    rules = settings.load("[flood]\nsources = 7\n[beacon]\nvariation = 1\nservice_ports = [5, 6]\n")
    assert rules["flood"].sources == 7 and rules["flood"].flows == detectors.Flood().flows
    assert rules["beacon"].variation == 1.0 and rules["beacon"].service_ports == (5, 6) and rules["scan"] == detectors.Scan()


@pytest.mark.parametrize("text", ["[other]\n", "flood = 1\n", "[flood]\nsorces = 1\n", "[flood]\nsources = true\n", "[flood]\nsources = 1.5\n", "[flood]\nsources = -1\n", "[beacon]\nvariation = inf\n", "[beacon]\nservice_ports = 7\n", "[scan]\ncoverage = 'x'\n"])
def test_wrong_settings_are_named(text):
    with pytest.raises(ValueError):
        settings.load(text)
