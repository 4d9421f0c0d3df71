from jsonweave.llm.licenses import TEMPLATES, scan_licenses

GNU = "This %s is free software%s you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version."
NOTICES = {
    "GPL-3.0": GNU % ("program", ":", "", ",", "3"),
    "AGPL-3.0": GNU % ("program", ":", "Affero ", ",", "3"),
    "GPL-2.0": GNU % ("program", ";", "", ";", "2"),
    "LGPL-2.1": GNU % ("library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0": GNU % ("library", ":", "Lesser ", ",", "3"),
    "CC-BY-4.0": TEMPLATES["CC-BY-4.0"][0],
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def test_siblings_are_told_apart(spark):
    names = list(NOTICES)
    docs = [(i, f"some words before {NOTICES[n]} and after") for i, n in enumerate(names)]
    got = scan_licenses(spark.createDataFrame(docs, "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in got] == names
