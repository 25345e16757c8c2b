"""Values among the keys of larger tables that the SQL of the queries takes for ordinary ones, and what the documented rules make of them."""

from hashlib import md5

import pytest

from saltmarsh.operators.scan import ScanConfig, Scanner
from saltmarsh.plans.catalog import RULESET
from saltmarsh.sources.boundary import Walk

FULL = Scanner(ScanConfig())


def body(key):
    return md5(f"0-{key}".encode()).hexdigest()


@pytest.mark.parametrize("key", (169750, 335230, 345190, 348622, 350686, 485878))
def test_assigned_value_under_three_bits_is_medium(key):
    (found,) = FULL.scan(f"API_KEY={body(key)}")
    assert (found.detector, found.confidence, found.start, found.end) == ("generic-token", 1, 8, 40)


@pytest.mark.parametrize("key", (266966, 732758))
def test_password_under_two_and_a_half_bits_is_medium(key):
    (found,) = FULL.scan(f"dsn postgresql://app:{body(key)[:20]}@db.internal:5432/main")
    assert (found.detector, found.confidence, found.start, found.end) == ("connection-string", 1, 21, 41)


def test_narrower_of_equal_candidates_stands():
    secret = "EAAA" + "BCDEFGH2" * 7 + "JKLM"
    found = FULL.scan(f"key dt0c01.{'ABCDEF23' * 3}.{secret} end")
    assert [(c.detector, c.start, c.end) for c in found] == [("square-token", 36, 100)]


def test_nested_value_under_three_bits_stays():
    walk = Walk(FULL)
    assert walk.value({"api_key": body(13197)}) == {"api_key": body(13197)} and walk.findings == 1


def test_names_of_a_ruleset_in_capitals():
    found = Scanner(ScanConfig(ruleset=RULESET)).scan('A, TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!')
    assert [(c.detector, c.start, c.end) for c in found] == [("ruleset-names", 12, 52)]
