import pytest

from larkfield.operators.extract import extract_imports, extract_symbols, extract_text, index_rows, with_extracted

RUBY = """require "set"
require_relative "grid_sync"
module Grids
  class Grid < ApplicationController
    # calculate power
    def sync(x)
      return 1 if x
      while x do x = nil end
      User.find(Billing::Invoice)
    end

    def self.all = nil
  end
end
"""
PYTHON = '''import os, sys
import numpy as np
from .grid_sync import Sync
from . import x

class Grid:
    """Doc."""

    def sync(self):  # hi
        return f"a{1}b"
'''
SCRIPT = """import { dep } from "./dep";
const FOO = 1, BAR = { a: [1, 2] };
export class MyClass extends Base {
  private x = 1;
  method(a: string): void { if (a) { run(); } }
  async other() { return `danger ${zone}`; }
}
function helper() { const z = require("./q"); /* zone */ }
"""


def names(lang, source):
    return [(s["name"], s["kind"]) for s in extract_symbols(lang, source)]


def test_symbols():
    assert names("ruby", RUBY)[:3] == [("Grids", "module"), ("Grid", "class"), ("sync", "method")]
    assert names("python", PYTHON) == [("Grid", "class"), ("sync", "function")]
    assert names("ts", SCRIPT) == [("FOO", "const"), ("BAR", "const"), ("MyClass", "class"), ("method", "method"), ("other", "method"), ("helper", "function"), ("z", "const")]
    grid = extract_symbols("python", PYTHON)[0]
    assert (grid["start_line"], grid["end_line"]) == (5, 9)
    assert PYTHON.encode()[grid["start_byte"] : grid["end_byte"]].startswith(b"class Grid")
    method = next(s for s in extract_symbols("ts", SCRIPT) if s["name"] == "method")
    assert (method["start_line"], method["end_line"]) == (4, 4)


def test_imports():
    hints = {(i["hint"], i["kind"]) for i in extract_imports("ruby", RUBY)}
    assert {("set", "require"), ("grid_sync", "require_relative"), ("Billing::Invoice", "ruby_const"), ("ApplicationController", "ruby_const"), ("User", "ruby_const")} <= hints
    assert [i["hint"] for i in extract_imports("python", PYTHON)] == ["os", "sys", "grid_sync", "."]
    assert [(i["hint"], i["kind"]) for i in extract_imports("ts", SCRIPT)] == [("./dep", "import"), ("./q", "require")]


def test_text():
    assert "# calculate power" in extract_text("ruby", RUBY)
    assert extract_text("python", PYTHON) == ['"""Doc."""', "# hi", 'f"a{1}b"']
    assert {"/* zone */", "`danger ${zone}`"} <= set(extract_text("js", SCRIPT))


@pytest.mark.parametrize("lang", ["ruby", "python", "ts", "js", "prose", None])
@pytest.mark.parametrize("source", [None, "", "class", "def (", "{{{", '"""', "`", "end end", "const", "from"])
def test_broken_sources(lang, source):
    assert isinstance(extract_symbols(lang, source), list)
    assert isinstance(extract_imports(lang, source), list)
    assert isinstance(extract_text(lang, source), list)


def test_index_rows(spark):
    files = spark.createDataFrame(
        [(1, "a.py", "python", PYTHON), (2, "b.md", "prose", "The Grid power_flow Grid"), (3, "c.bin", None, None)], "file_id long, path string, lang string, text string"
    )
    rows = {r.file_id: r for r in index_rows(with_extracted(files)).collect()}
    assert rows.keys() == {1, 2}
    assert rows[1].symbol_names == "Grid sync" and rows[1].keywords.split()[:2] == ["grid", "sync"]
    assert rows[2].symbol_names == "" and rows[2].keywords == rows[2].content == "grid power_flow"
