"""Pieces of licence texts, which no template is, and notices that must not be taken for a piece of another licence."""

import os
import re

from notegraph.llm import licenses
from test_llm_operators import prose

NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU Affero General Public License for more details.
#
# You should have received a copy of the GNU Affero General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
import os
"""


def texts():
    for file in sorted(os.listdir(licenses.FOLDER)):
        with open(os.path.join(licenses.FOLDER, file), encoding="utf-8", errors="replace") as f:
            yield "BSD-3-Clause" if file == "BSD" else re.sub(r"-(\d)$", r"-\1.0", file), f.read()


def test_parts_of_texts(spark):
    rows = []
    for name, text in texts():
        half = len(text) // 2
        rows += [(name, text[:half]), (name, text[half:]), (name, text[half : half + half // 2])]
        rows += [(name, text[:1500])] if len(text) > 3000 else []
    rows += [(name, text[: len(text) // 2]) for name, text in licenses.TEXT_TEMPLATES]
    rows += [("AGPL-3.0", NOTICE)]
    rows += [(None, f"{prose(300, k)}\nthe license and copyright of {prose(300, 77 + k)}") for k in range(20)]
    d = spark.createDataFrame([(k, f"p{k}/f.txt", t) for k, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan(d).collect()}
    wrong = [(k, n, got[k]) for k, (n, _) in enumerate(rows) if got[k] != n]
    # versions that share a whole passage word for word cannot be told apart there
    same = {frozenset(("GFDL-1.2", "GFDL-1.3")), frozenset(("LGPL-2.0", "LGPL-2.1")), frozenset(("GPL-1.0", "GPL-2.0"))}
    assert all(frozenset((n, g)) in same for _, n, g in wrong), wrong
    assert len(wrong) <= 2, wrong


def test_empty_folder(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", licenses.TEXT_TEMPLATES[0][1]), (2, "b", None)], "doc_id long, path string, text string")
    for folder in (None, str(tmp_path)):
        assert {r.doc_id: (r.license, r.declared) for r in licenses.scan(d, folder=folder).collect()}[1] == ("MIT", True)
