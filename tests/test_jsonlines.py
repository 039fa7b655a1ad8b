import json
import random

from pyspark.sql import functions as F

from lectern.functions import jsonlines
from lectern.sources import readers

PLAIN = ['{"text":"a"}', '{"text": "a\\"b\\\\ \\u00e9 \\n", "n": [1, -2.5e3, true, null, {"k": {}}]}', '"s"', '""', '{}', ' {"content" : "c"}\t', '{"text":1,"content":"c"}', '{"prompt":"p","answer":"a"}', '{"a":{"b":{"c":{"d":1}}},"text":"deep"}', '{"text":"é 中 😀"}', '{"text":"' + "x\\n" * 20_000 + '"}']
ODD = [
    '{"text":"a","n":NaN}', '{"text":"a","n":-Infinity}', '{"text":"a"} x', '{"text":"a","text":"b"}', '{"text":"a","n":01}', '{"n":01,"text":"a"}', '{"text":"\\ud800"}', '{"text":"\\ud83d\\ude00"}', '{"text":"a",}', "{'text':'a'}", '["x", {"a": null}]', "3", "01", "true", "NaN", "",
    '{"text":"raw\ttab"}', '{"text":"a\\x"}', '{"text":"a" "b":1}', '{"text":"a" 1}', '[1 2]', '{"text":}', '{"text":"unclosed', "not json", '{"a":1}{"b":2}', "[" * 5 + "]" * 5, '{"text":"in","x":' + "[" * 8 + "]" * 8 + "}", "[" * 200_000, '{"x":' * 300 + "1" + "}" * 300, '﻿{"text":"a"}', '{"text":"a","n":1e999}', '{"text":"a","n":' + "9" * 60 + "}", '{"text":"a","n":.5}', '{"text":"a","n":5.}', '{"text":"a","n":+1}', '{"text":"a","n":tru}', 'tr ue', '\x01', '{"text":"\\u00g0"}', '{"text\\"":"q","text":"r"}', '{"text":null}',
]


def expected(line):
    """(kind, error?, whole, strings by name) by Python's parser."""
    try:
        v = json.loads(line)
    except (ValueError, RecursionError):
        return (None, True, None, {})
    clean = lambda s: s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(v, dict):
        return ("object", False, None, {n: clean(v[n]) for n in jsonlines.NAMES if isinstance(v.get(n), str)})
    kind = "string" if isinstance(v, str) else "array" if isinstance(v, list) else "scalar"
    return (kind, False, clean(str(v)), {})


def shown(r):
    return (r.kind, r.error is not None, r.whole, {n: r[n] for n in jsonlines.NAMES if r[n] is not None})


def broken(rng):
    """A line near to JSON."""
    s = list(rng.choice(PLAIN[:10] + ODD[:26]))
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and s:
            del s[min(k, len(s) - 1)]
        else:
            s.insert(k, rng.choice('{}[]:,"\\ 0129-.eEtn\n\x01é'))
    return "".join(s)


def test_reads_as_python_does(spark):
    rng = random.Random(11)
    lines = PLAIN + ODD + [broken(rng) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    got = df.select("i", jsonlines.read(F.col("line")).alias("r"), jsonlines.alike(F.col("line")).alias("alike")).collect()
    wrong = [(lines[g.i][:200], shown(g.r), expected(lines[g.i])) for g in got if shown(g.r) != expected(lines[g.i])]
    assert not wrong, wrong[:5]
    native = {g.i for g in got if g.alike}
    assert native >= set(range(len(PLAIN))), "plain lines stay out of Python"
    assert all(expected(lines[i])[1] is False for i in native)
    assert spark.createDataFrame([(None,)], "line string").select(jsonlines.read(F.col("line")).alias("r")).first().r.asDict() == dict.fromkeys(("kind", "error", "whole", *jsonlines.NAMES))


def test_texts_of_lines(spark):
    cases = {
        '{"text":"a","n":NaN}': "a", '{"text":"a"} x': '{"text":"a"} x', '{"text":"a","text":"b"}': "b", " plain ": "plain", '{"text":"","content":"c"}': "", '{"text":" a "}': " a ", '["x"]': "", "7": "", '"s"': "s", '{"prompt":"p","answer":"q"}': "p\nq", '{"prompt":"p"}': "", '{"document":"d","passage":"p"}': "p",
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    assert {r.value: r.t for r in df.select("value", readers.text_of(F.col("value")).alias("t")).collect()} == cases


def test_training_rows_lose_no_line(spark):
    lines = ['{"text":"a","n":NaN}', '["x", 1]', "3.0", "null", '"s"', "no json", '{"prompt":"p","answer":"q"}', '{"text":"a"} x']
    got = readers.training_rows(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, value string"), "i").orderBy("i").collect()
    assert [r.raw for r in got] == [None, "['x', 1]", "3.0", "None", "s", "no json", None, '{"text":"a"} x']
    assert got[0].text == "a" and got[6].prompt == "p"
