from corpusloom.operators import bibliography as B
from corpusloom.operators import grounding as G
from corpusloom.sources import models as M


def test_quotes():
    passages = {"a": "The pump must run at 40 bar. It is red.", "b": "Valves are closed."}
    assert G.verify_quote("the pump must run at 40 bar", passages, "a") == ("exact", "a")
    assert G.verify_quote("The pump must run at 50 bar.", passages, "a") == ("missing", None)
    assert G.verify_quote("Valves are closed", passages, "a") == ("relocated", "b")
    assert G.check_answer("It is 40 bar [1]. It is 41 bar [1]. No source.", [passages["a"]])[1][2] == ["41"]


def test_authors():
    assert B.parse_author("van der Berg, Jan") == (["Jan"], "van der Berg")
    assert B.parse_author("Jan van der Berg") == (["Jan"], "van der Berg")
    assert B.parse_author("Plato") == ([], "Plato")
    item = {"authors": ["Ann Smith", "Bo Li"], "year": 2024, "title": "On X", "venue": "J", "doi": "10.1/x"}
    assert B.reference(item) == "Smith, A., & Li, B. (2024). On X. J. https://doi.org/10.1/x"
    assert B.reference({}, "ieee").startswith("“Untitled,”")
    assert "author = {Ann Smith and Bo Li}" in B.export(item, "bibtex", "k")


def test_models():
    source = """<opsa-mef><define-fault-tree name="F"><define-gate name="T"><or><gate name="G"/><not><basic-event name="c"/></not></or></define-gate>
      <define-gate name="G"><atleast min="2"><basic-event name="a"/><basic-event name="b"/><basic-event name="c"/></atleast></define-gate>
      <define-basic-event name="a"><exponential><parameter name="r"/><system-mission-time/></exponential></define-basic-event></define-fault-tree>
      <model-data><define-parameter name="r"><float value="1e-5"/></define-parameter><define-house-event name="h"><constant value="true"/></define-house-event></model-data></opsa-mef>"""
    gates, events = M.read_mef(source)
    assert ("T", "or", 0, "G /c") in gates and ("G", "atleast", 2, "a b c") in gates
    assert round(events[0][2], 6) == 0.083873 and events[1] == ("h", "house", 1.0)
    assert M.products("A * /B +\n C .") == [["A", "/B"], ["C"]] and M.products("<TRUE>.") == [[]]
