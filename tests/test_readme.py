import re
from pathlib import Path

import __spark_entry__


def test_every_identifier_of_the_table_has_a_query():
    rows = re.findall(r"^\| [^|]+ \| ([A-Z]\d\d[^|]*) \|$", (Path(__file__).parent.parent / "README.md").read_text(), re.M)
    claimed = set()
    for part in ", ".join(rows).split(", "):
        low, _, high = part.partition(" to ")
        claimed |= {f"{low[0]}{n:02}" for n in range(int(low[1:]), int((high or low)[1:]) + 1)}
    assert len(rows) == 9 and claimed <= {name.split("_")[0] for name in __spark_entry__.queries()}
