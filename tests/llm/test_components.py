import random

import pytest

from quarrylog.llm.components import components


@pytest.mark.parametrize("kind", ["random", "star", "chain"])
def test_components(spark, kind):
    rnd = random.Random(2)
    names = [bytes([x]) + b"node" for x in rnd.sample(range(256), 120)]
    if kind == "random":
        links = [tuple(rnd.sample(names, 2)) for _ in range(90)]
    elif kind == "star":
        links = [(names[60], x) for x in names]
    else:
        links = list(zip(names, names[1:], strict=False))
    up = {n: n for n in names}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {n: root(n) for link in links for n in link if link[0] != link[1]}
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == want
