"""Characters and patterns of translator replies.

Both forms of the reply functions, for columns and for the translator ladder,
are made from these.
"""

from __future__ import annotations

# Role names that a model may echo as a line.
ROLES = ("user", "assistant", "system")
# Marks that a reply loses at its head.
HEAD_MARKS = ".…⋯︙·-—~～"
# What runs of a mark become.
REPEATED = (("[.．]{2,}", "…"), ("[-—―ー]{2,}", "—"), ("[~～]{2,}", "~"))
# Ideographs and kana, between which blanks are dropped.
IDEOGRAPHS = "一-鿿぀-ヿ"
# The number at the head of a line.
INDEX = r"^\s*\[?\d+\]?[\s.:：、\-—]*"
NUMBERED = r"^\s*\[?(\d+)\]?[\s.:：、\-—]*(.*)$"

HEAD = "^[\\s\u00a0\u3000" + HEAD_MARKS.replace("-", r"\-") + "]+"
BETWEEN = rf"(?<=[{IDEOGRAPHS}])[ \t　]+(?=[{IDEOGRAPHS}])"
