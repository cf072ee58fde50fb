"""The declarations that stand most often in real files, each in words of its own around it."""

import pytest

from notegraph.llm import licenses

LINES = {
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "LGPL-2.1",
    "-- SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "Frobnicator is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "AGPL-3.0",
    "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.": "BSD-3-Clause",
    "we talked about the license of the new tool and its identifier": None,
    "a license for the car, version 2 of the form, is at the office": None,
}


@pytest.mark.parametrize("folder", [None, licenses.FOLDER])
def test_declared_lines(spark, folder):
    rows = [(k, f"d{k}/f.c", f"some code here\n{line}\nint main() {{ return {k}; }}") for k, line in enumerate(LINES)]
    rows += [(1000 + k, f"e{k}/x.txt", "plain words " * 30) for k in range(200)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), folder=folder).collect()}
    assert {line: got[k] for k, line in enumerate(LINES)} == LINES
    assert all(got[1000 + k] is None for k in range(200))
