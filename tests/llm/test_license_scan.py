from tamis.llm import license_scan as L

BSD = ["All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
       "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
CASES = [
    (None, [], "none"), ("", [], "none"), ("No licence here. MIT", [], "none"), ("x\nReleased under the MIT License.\ny", ["MIT"], "permissive"), ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"], "permissive"),
    ("This work is licensed under the GNU General Public License, version 3; or (at your option) any later version.", ["GPL-3.0-or-later"], "copyleft"),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"], "copyleft"), ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "Proprietary"], "proprietary"),
    ("licensed under cc by-nc 4.0", ["CC-BY-NC-4.0"], "noncommercial"), (" ".join(BSD), ["BSD-2-Clause"], "permissive"), ("\n".join(BSD[1:] + BSD[:1]), ["BSD-2-Clause", "Proprietary"], "proprietary"),
    ("Released under the MIT License. Released under the MIT License.", ["MIT"], "permissive"), ("é. Released under the MIT License!é", ["MIT"], "permissive"), ("Xreleased under the MIT License", [], "none"), ("word. " * 20000 + "Released under the MIT License", ["MIT"], "permissive"),
]


def test_cases(spark):
    rows = [(k, t, "clash") for k, (t, _, _) in enumerate(CASES)] + [(None, CASES[3][0], "clash")]
    found = {r.doc_id: (r.licenses, r.category) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()}
    for k, (text, licenses, category) in enumerate(CASES):
        assert found[k] == (licenses, category), text
    assert found[None] == (["MIT"], "permissive")


def test_empty_table(spark):
    assert L.digest(L.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_every_rule_uses_known_sentences():
    names = set(L.sentences().values())
    assert all(set(pattern) <= names for pattern, _ in L.rules())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"


def test_wrapped_notices_and_tags(spark):
    cases = [
        (MIT, ["MIT"]), (MIT.replace("\n", "\r\n"), ["MIT"]), ("".join(f"# {x}\n" for x in MIT.split("\n")), ["MIT"]), (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0-or-later"]), (GPL.replace("version 3", "version 2").replace(", or\n(at your option) any later version", ""), ["GPL-2.0"]),
        (MPL, ["MPL-2.0"]), ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", ["BSD-3-Clause"]), ("MIT\nunknown words here", []), ("a line of\nReleased under the MIT License\nand one more", ["MIT"]),
    ]
    found = {r.doc_id: r.licenses for r in L.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert found == {k: licenses for k, (_, licenses) in enumerate(cases)}
