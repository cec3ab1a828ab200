from strophe.llm.canonical import token_ways
from strophe.llm.leakage import Index
from strophe.llm.names_queries import KINDS
from strophe.llm.packing import pack
from strophe.llm.pieces import split_text
from strophe.llm.readings import Readings
from tests.test_travel import loads_elsewhere


def test_functions_travel(tmp_path):
    r = Readings({}, {"山": "shan"}, frozenset({"shan"}))
    loads_elsewhere(tmp_path, [token_ways, Index, pack, split_text, *[p for p, _ in KINDS.values()]])
    loads_elsewhere(tmp_path, (KINDS["song_name"][0], r), "x[0]('shanshanshanshan', x[1]).syllables == ['shan'] * 4")
