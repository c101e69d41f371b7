"""Licence texts as they usually stand in files: wrapped, indented, behind comment marks."""

import textwrap

import pytest

from callsheet.llm import licences

MIT = """MIT License

Copyright (c) 2020 X. Ample

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""  # noqa: E501
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""  # noqa: E501
BSD_3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""  # noqa: E501
ISC = """Copyright X

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""  # noqa: E501
GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""  # noqa: E501
GPL_2 = GPL_3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
LGPL = GPL_3.replace("GNU General", "GNU Lesser General").replace("This program is free", "This library is free")
AGPL = GPL_3.replace("GNU General", "GNU Affero General")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""  # noqa: E501
TEXTS = {"LGPL-3.0-or-later": LGPL, "LGPL-2.1-or-later": LGPL.replace("version 3", "version 2.1"), "AGPL-3.0-or-later": AGPL, "Zlib": ZLIB, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD_3, "ISC": ISC, "GPL-3.0-or-later": GPL_3, "GPL-2.0-or-later": GPL_2,
         "Apache-2.0": APACHE}


@pytest.mark.parametrize("mark,end", [("", "\n"), ("# ", "\n"), (" * ", "\n"), ("// ", "\r\n")])
def test_wrapped_licences(spark, mark, end):
    rows = []
    for name, text in TEXTS.items():
        for width in (40, 72, 79):
            lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width, break_on_hyphens=False), ""]]
            rows.append((name, width, end.join((mark + x).rstrip(" ") for x in ["def f():", "", *lines, "import this"])))
    got = licences.scan(spark.createDataFrame(rows, "name string, width int, text string")).collect()
    assert [(r.name, r.width, r.licences) for r in got] == [(n, w, [n]) for n, w, _ in rows]


def test_a_known_sentence_is_whole(spark):
    texts = ["We are not\nreleased under the MIT\nLicense.", "Neither released under the MIT License\nnor any other.",
             "Code:\nreleased under the MIT\nLicense", "Released under the.\nMIT License", "Released under the\n\nMIT License", "Released under\nthe MIT\nLicense\nsince 2020"]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert [r.licences for r in got] == [["MIT"], [], ["MIT"], [], [], ["MIT"]]


@pytest.mark.parametrize("holder", ["Example Inc.", "the University of X. Ample", "Jane Doe", "the <organization>", "ACME Co., Ltd."])
def test_the_holders_name_does_not_matter(spark, holder):
    named = BSD_3.replace("the copyright holder", holder)
    rows = [(w, "\n".join(x for part in named.split("\n\n") for x in [*textwrap.wrap(part, w, break_on_hyphens=False), ""])) for w in (40, 72, 1000)]
    got = licences.scan(spark.createDataFrame(rows, "width int, text string")).collect()
    assert [r.licences for r in got] == [["BSD-3-Clause"]] * 3
    far = "Neither the name of this " + "very " * 20 + "nor the names of its contributors may be used to endorse or promote products"
    assert licences.scan(spark.createDataFrame([(far,)], "text string")).first().licences == []
