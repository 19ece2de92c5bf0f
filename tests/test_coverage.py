"""COVERAGE.md names only what is there, with a line for each identifier."""

import importlib
import os
import pkgutil
import re

import pytest
from conftest import ROOT

import quern
from quern.plans.registry import ORACLE, QUERIES

with open(os.path.join(ROOT, "COVERAGE.md")) as f:
    LINES = [[c.strip() for c in x.strip("|\n").split("|")] for x in f if re.match(r"\| [A-Z]+-\d+ ", x)]
MODULES = {m.name.split(".")[-1]: m.name for m in pkgutil.walk_packages(quern.__path__, "quern.") if not m.name.startswith("quern.llm")}
TESTS = {t for name in os.listdir(os.path.join(ROOT, "tests")) if name.endswith(".py") for t in re.findall(r"^def (test_\w+)", open(os.path.join(ROOT, "tests", name)).read(), re.M)}


def test_identifiers_are_distinct():
    assert len({x[0] for x in LINES}) == len(LINES) == 407


@pytest.mark.parametrize("line", LINES, ids=[x[0] for x in LINES])
def test_line(line):
    _, _, state, functions, held, missing = line
    assert state in ("yes", "partial", "plug-in", "no") and (state in ("yes",)) == (missing == "")
    for name in re.findall(r"(\w+)\.(\w+)", functions):
        assert hasattr(importlib.import_module(MODULES[name[0]]), name[1]), name
    named = re.findall(r"`(\w+)`( = SQL)?", held)
    assert named or state == "no"
    for name, sql in named:
        assert name in TESTS or name in QUERIES and bool(sql) <= (name in ORACLE), name
