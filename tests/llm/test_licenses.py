import re
import textwrap

from bundleflow.llm import licenses


def test_equivalent_wordings_and_cases(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, f"Copyright (c) 2020 Somebody\n\n{apache.upper()}"), (2, "licenced under the APACHE licence version 2.0"), (3, f"some words\n{apache}\n{apache}\nend"),
        (4, None), (5, ""), (6, apache + " and more"), (None, apache), (3, apache), (7, "x " * 100000 + "\n" + apache),
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.license_id, r.n_notices, r.notices) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()), key=repr)
    a = "Apache-2.0"
    assert got == sorted(
        [(1, a, 1, a), (2, a, 1, a), (3, None, 2, a), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (None, a, 1, a), (3, a, 1, a), (7, None, 1, a)], key=repr
    )
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).count() == 0


def rewrapped(text, width):
    """The text with other line ends, quotes and dashes; copyright lines stay lines."""
    notice = r"[ \t]*copyright[^\n]*(?:\d{4}|\(c\)|yyyy)[^\n]*"
    text = re.sub(rf"(?mi)^({notice})$", r"\n\n\1\n\n", text)
    whole = re.compile(notice, re.I).fullmatch
    paragraphs = [p if whole(p) else textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n[ \t]*\n", text)]
    return "\n\n".join(paragraphs).replace('"', "``").replace(",", " ,")


def test_whole_texts_rewrapped_and_repunctuated(spark):
    common = {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0"}
    assert common <= {i for i, _ in licenses.NOTICES}
    rows = [(i, f"Copyright (c) 2019 Some Body\n\n{rewrapped(t, width)}", i) for i, t in licenses.NOTICES for width in (47, 72, 10**6)]
    docs = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [(rows[n][0], got[n], rows[n][1][:90]) for n in sorted(got) if got[n] != rows[n][2]] == []
