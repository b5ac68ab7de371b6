"""Fault-tree models: Open-PSA XML and cut-set text as rows of gates, basic events and products."""

from __future__ import annotations

import math
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

HOURS = 8760.0


def evaluate(node, parameters: dict) -> float:
    """A scalar expression: literals, parameters, arithmetic, the exponential law, deviates by their mean."""
    tag = node.tag.rsplit("}", 1)[-1]
    args = [evaluate(c, parameters) for c in node if c.tag not in ("label", "attributes")]
    if tag in ("float", "int"):
        return float(node.attrib["value"])
    if tag == "bool":
        return float(node.attrib["value"] == "true")
    if tag == "parameter":
        value = parameters[node.attrib["name"]]
        return evaluate(value, parameters) if not isinstance(value, float) else value
    if tag == "system-mission-time":
        return HOURS
    if tag == "exponential":
        return -math.expm1(-args[0] * args[1])
    if tag in ("uniform-deviate",):
        return (args[0] + args[1]) / 2
    if tag in ("normal-deviate", "lognormal-deviate"):
        return args[0]
    if tag == "gamma-deviate":
        return args[0] * args[1]
    if tag == "beta-deviate":
        return args[0] / (args[0] + args[1])
    if tag == "neg":
        return -args[0]
    if tag == "sub":
        return args[0] - sum(args[1:])
    if tag == "div":
        out = args[0]
        for a in args[1:]:
            out /= a
        return out
    return {"add": sum, "mul": math.prod}[tag](args)


def read_mef(source: str) -> tuple[list[tuple], list[tuple]]:
    """(gates, events) of an Open-PSA model: (name, type, k, inputs) and (name, probability)."""
    root = ElementTree.fromstring(source)
    parameters = {e.attrib["name"]: next(c for c in e if c.tag not in ("label", "attributes")) for e in root.iter("define-parameter")}
    gates = []
    made = 0

    def formula(name: str, node) -> None:
        nonlocal made
        inputs = []
        for c in node:
            if c.tag in ("gate", "basic-event", "house-event", "event"):
                inputs.append(c.attrib["name"])
            elif c.tag == "not":
                inputs.append("/" + next(iter(c)).attrib["name"])
            elif c.tag in ("and", "or", "atleast"):
                made += 1
                inner = f"{name}.{made}"
                formula(inner, c)
                inputs.append(inner)
        gates.append((name, node.tag, int(node.attrib.get("min", 0)), " ".join(inputs)))

    for g in root.iter("define-gate"):
        body = next(c for c in g if c.tag not in ("label", "attributes"))
        if body.tag in ("and", "or", "atleast"):
            formula(g.attrib["name"], body)
        else:
            gates.append((g.attrib["name"], "or", 0, body.attrib["name"] if body.tag != "not" else "/" + next(iter(body)).attrib["name"]))
    events = []
    for tag in ("define-basic-event", "define-house-event"):
        for e in root.iter(tag):
            body = [c for c in e if c.tag not in ("label", "attributes")]
            value = evaluate(body[0], parameters) if body and body[0].tag != "constant" else float(bool(body) and body[0].attrib["value"] == "true")
            events.append((e.attrib["name"], "house" if "house" in tag else "basic", value))
    return gates, events


def products(text: str) -> list[list[str]]:
    """Cut-set text: `*` joins events, `+` parts products, `.` ends; <TRUE> is the empty product."""
    body = text.strip().rstrip(".")
    return [[] if p.strip() == "<TRUE>" else [e.strip() for e in p.split("*") if e.strip()] for p in body.split("+") if p.strip()]


def model_frames(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    gates, events = read_mef(source)
    return (
        spark.createDataFrame(gates, "name string, type string, k int, inputs string"),
        spark.createDataFrame([(n, k, p, None, None) for n, k, p in events], "name string, kind string, probability double, failure_rate double, mission_time double"),
    )
