"""Functions that run in workers must load where the package is not installed."""

import subprocess
import sys

from pyspark import cloudpickle

from strophe.functions.text import fold_text
from strophe.operators.kernels import indel_ratio, note_scores
from strophe.operators.packed import tokenize_cell
from strophe.operators.spatial import cover_region
from strophe.sources.notation import parse_midi


def loads_elsewhere(tmp_path, functions, check="all(map(callable, x))"):
    f = tmp_path / "f.pkl"
    f.write_bytes(cloudpickle.dumps(functions))
    code = f"import pickle, pyspark.cloudpickle; x = pickle.load(open({str(f)!r}, 'rb')); assert {check}"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_core_functions_travel(tmp_path):
    loads_elsewhere(tmp_path, [tokenize_cell, fold_text, indel_ratio, note_scores, cover_region, parse_midi])
    loads_elsewhere(tmp_path, fold_text, "x('Ａ​ b') == 'a b'")
