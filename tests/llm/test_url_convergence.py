"""Trust and distrust are carried until they stand still, however long a chain of links is."""

import numpy as np
import pytest

from paperweir.llm import urlfilter

CHAIN = [("h%02d" % i, "h%02d" % (i + 1)) for i in range(11)] + [("h03", "h01"), ("h07", "h05")]


def ranks(links, hosts, seed, damping=0.5):
    """The same equation, solved as a linear system."""
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}
    w = np.zeros((n, n))
    for a, b in links:
        w[at[b], at[a]] = 1
    out = w.sum(0)
    w[:, out > 0] /= out[out > 0]
    p = np.zeros(n)
    p[at[seed]] = 1
    m = damping * (w + np.outer(p, out == 0))
    return np.linalg.solve(np.eye(n) - m, (1 - damping) * p)


def test_long_chain(spark):
    hosts = sorted({h for e in CHAIN for h in e})
    edges = spark.createDataFrame([(a, b, 1) for a, b in CHAIN], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h00", 1, 0), ("h11", 0, 1)], "host string, good long, bad long")
    out = {r.host: r for r in urlfilter.host_trust(edges, seeds, 0.5).collect()}
    trust, distrust = ranks(CHAIN, hosts, "h00"), ranks([(b, a) for a, b in CHAIN], hosts, "h11")
    assert np.allclose([out[h].trust for h in hosts], trust, atol=1e-8) and np.allclose([out[h].distrust for h in hosts], distrust, atol=1e-8)
    assert out["h11"].trust > 0 and out["h00"].distrust > 0
    with pytest.raises(RuntimeError):
        urlfilter.host_trust(edges, seeds, 0.5, rounds=4)
