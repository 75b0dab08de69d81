from test_ngram_join import brute

from quillon.llm.ngram_join import N, THRESHOLD


def jaccard_brute(rows):
    """Ids that go when one document of each connected group stays."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute(rows, THRESHOLD, N):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x for x in parent if root(x) != x}
