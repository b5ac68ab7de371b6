"""Risk models over several files, and event trees, against what the files say and against enumeration."""

import itertools

import pytest

from corpusloom.sources import mard as M

FILES = {
    "FTL": """DEMO, COOL =
* a comment
COOL        OR    BOTH COOL-CCF
BOTH        AND   TRAIN-A TRAIN-B
TRAIN-A     OR    PUMP-A SUPPLY
TRAIN-B     2/3   PUMP-B /OPERATOR
            VALVE
SUPPLY      TRAN
^EOS
DEMO, SUPPLY =
SUPPLY      OR    TANK
LOST        ODD   TANK
^EOS
DEMO, COPY =
BOTH        OR    PUMP-A
COPY        NOT   BOTH
OUT         TRAN
^EOS
""",
    "BEI": """DEMO =
* Name, FdT, UdC, UdT, UdValue, Prob, Lambda, Tau, Mission, Init, PF, UdValue2, Calc. Prob
PUMP-A, 1, , L, 5.0, 1.0E-3, , , , , , , 2.0E-3
PUMP-B, 3, , , , , 1.0E-4, , 24, , , , 2.4E-3
OPERATOR, T, , , , , , , , , , ,
IE-STOP, 1, , , , 0.5, , , , I, , , 0.5
wrapped header row
""",
    "BED": 'DEMO =\nPUMP-A, "PUMP A, FAILS  TO START", DEMO\nTANK, TANK EMPTY, DEMO\n',
    "ETL": """DEMO, STOP, IE-STOP =
^TOPS
TRIP, COOL,
FEED
^LOGIC 1
 +1.0 +2.0  3.0
      -2.0 +3.0   // branches off
           -3.0
 -1.0  2.0  3.0
^SEQUENCES 0
N, Sequence Name, Y, End State, Y, Frequency, N, Comments,
Y, ,Y, OK,Y, ,Y, ,,
Y, two,Y, OK,Y, 1.5E-5,Y, cooled late,,
Y, ,Y, CD,Y, ,Y, ,,
Y, ,Y, ATWS,Y, ,Y, ,T,
^EOS
""",
    "SQL": "DEMO, STOP, 03 =\n/TRIP COOL\nFEED .\n^EOS\n",
    "SQC": "DEMO, STOP, 03,\nRANDOM/CD =\nPUMP-A * PUMP-B +\nCOOL-CCF .\n^EOS\n",
    "FTC": "DEMO, COOL =\nTANK + PUMP-A *\nPUMP-B + <TRUE>.\n^EOS\n",
    "XYZ": "ignored",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mard")
    for kind, text in FILES.items():
        (folder / f"DEMO.{kind}").write_text(("﻿" if kind == "ETL" else "") + text.replace("\n", "\r\n" if kind == "BEI" else "\n"))
    return M.lines(spark, str(folder))


def test_gates(rows):
    gates = M.gates(rows)
    got = {g.name: (g.type, g.k, g.tree, g.inputs) for g in gates.collect()}
    assert got == {
        "COOL": ("or", None, "COOL", ["BOTH", "COOL-CCF"]), "BOTH": ("and", None, "COOL", ["TRAIN-A", "TRAIN-B"]), "TRAIN-A": ("or", None, "COOL", ["PUMP-A", "SUPPLY"]),
        "TRAIN-B": ("atleast", 2, "COOL", ["PUMP-B", "/OPERATOR", "VALVE"]), "SUPPLY": ("or", None, "SUPPLY", ["TANK"]), "LOST": ("other", None, "SUPPLY", ["TANK"]), "COPY": ("not", None, "COPY", ["BOTH"]), "OUT": ("transfer", None, "COPY", ["OUT"]),
    }
    assert {t.tree: t.top for t in M.tops(gates).collect()} == {"COOL": "COOL", "SUPPLY": "SUPPLY", "COPY": "COPY"}


def test_events(rows):
    got = {e.name: e for e in M.events(rows, M.gates(rows)).collect()}
    assert {n: e.kind for n, e in got.items()} == {"PUMP-A": "basic", "PUMP-B": "basic", "OPERATOR": "house", "IE-STOP": "initiating", "COOL-CCF": "basic", "VALVE": "basic", "TANK": "basic"}
    assert (got["PUMP-A"].probability, got["PUMP-A"].uncertainty, got["PUMP-A"].description) == (2e-3, "lognormal EF=5.0", "PUMP A, FAILS TO START")
    assert (got["PUMP-B"].failure_rate, got["PUMP-B"].mission_time, got["OPERATOR"].probability, got["TANK"].description, got["VALVE"].probability) == (1e-4, 24, 1.0, "TANK EMPTY", None)


def test_event_tree(rows):
    tops, sequences = M.event_trees(rows)
    assert [(t.tree, t.initiating_event, t.place, t.top) for t in tops.orderBy("place").collect()] == [("STOP", "IE-STOP", 1, "TRIP"), ("STOP", "IE-STOP", 2, "COOL"), ("STOP", "IE-STOP", 3, "FEED")]
    got = {s.name: s for s in sequences.collect()}
    path = {n: [(p.top, p.state[0]) for p in s.path] for n, s in got.items()}
    assert path == {"01": [("TRIP", "s"), ("COOL", "s")], "02": [("TRIP", "s"), ("COOL", "f"), ("FEED", "s")], "03": [("TRIP", "s"), ("COOL", "f"), ("FEED", "f")], "04": [("TRIP", "f")]}
    assert [(got[n].end_state, got[n].transfer, got[n].frequency, got[n].description) for n in ("01", "02", "04")] == [("OK", None, None, None), ("OK", None, 1.5e-5, "two - cooled late"), (None, "ATWS", None, None)]
    assert got["03"].logic == ["/TRIP", "COOL", "FEED"] and got["01"].logic is None


def test_cut_sets(rows):
    got = sorted((c.kind, c.context, c.event_tree or "", c["rank"], c.events, c.order) for c in M.cut_sets(rows).collect())
    assert got == [("fault_tree", "COOL", "", 1, "TANK", 1), ("fault_tree", "COOL", "", 2, "PUMP-A * PUMP-B", 2), ("fault_tree", "COOL", "", 3, "", 0), ("sequence", "03", "STOP", 1, "PUMP-A * PUMP-B", 2), ("sequence", "03", "STOP", 2, "COOL-CCF", 1)]


def test_paths_and_frequencies_equal_enumeration(spark):
    trees = {"a": [0.1, 0.25, 0.5], "b": [0.3]}
    tops = spark.createDataFrame([(t, k + 1, f"t{k}", p) for t, ps in trees.items() for k, p in enumerate(ps)], "event_tree string, place int, top string, p double")
    paths = M.expanded(tops.drop("p"))
    got = {(r.event_tree, r.sequence): (r.failures, r.frequency) for r in M.frequencies(paths, tops.drop("place"), spark.createDataFrame([("a", 2.0), ("b", 3.0)], "event_tree string, frequency double")).collect()}
    want = {}
    for t, ps in trees.items():
        for n, states in enumerate(itertools.product([0, 1], repeat=len(ps)), 1):
            f = 2.0 if t == "a" else 3.0
            for p, s in zip(ps, states):
                f *= p if s else 1 - p
            want[t, n] = (sum(states), pytest.approx(f))
    assert got == want
    with pytest.raises(ValueError):
        M.expanded(tops.drop("p"), most=2)


def test_too_many_cut_sets_are_an_error():
    from corpusloom.operators.risk import cut_sets_of

    gates = {"T": ("and", 0, [f"g{k}" for k in range(6)])} | {f"g{k}": ("or", 0, [f"e{k}{j}" for j in range(4)]) for k in range(6)}
    assert len(cut_sets_of(gates, {}, "T")) == 4**6
    with pytest.raises(ValueError):
        cut_sets_of(gates, {}, "T", most=1000)
