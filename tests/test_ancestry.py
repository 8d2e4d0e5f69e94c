import random
from datetime import datetime, timedelta

from conftest import values
from repoloom.operators import ancestry, release

KINDS = (
    "repo string, ts timestamp, hash string, subject string, body string, parents array<string>, n int",
    "repo string, version string, hash string",
    "repo string, hash string",
)


def closure(parents, starts):
    seen, todo = set(), list(starts)
    while todo:
        x = todo.pop()
        if x in parents and x not in seen:
            seen.add(x)
            todo += parents[x] or []
    return seen


def by_hand(commits, tags, heads):
    pending, nearest = set(), {}
    for repo in {c[0] for c in commits}:
        parents = {c[2]: c[5] for c in commits if c[0] == repo}
        reached = closure(parents, [h for r, h in heads if r == repo])
        found = [
            (len(closure(parents, [h])), v, h)
            for r, v, h in tags
            if r == repo and v.startswith("v") and h in reached
        ]
        old = set()
        if found:
            _, version, at = max(found)
            nearest[repo] = version
            old = closure(parents, [at])
        pending |= {(repo, h) for h in reached - old}
    return sorted(pending, key=repr), nearest


def history(rng, repo, size, merges):
    """Commits with random parents among the last few, times in no order."""
    day = datetime(2024, 1, 1)
    out = []
    for i in range(size):
        pool = [f"{repo}-{j}" for j in range(max(0, i - 6), i)]
        parents = rng.sample(pool, min(len(pool), 1 + (rng.random() < merges) + (rng.random() < merges / 4)))
        ts = day + timedelta(days=rng.randrange(400))
        out.append((repo, ts, f"{repo}-{i}", rng.choice(["feat: more", "fix: less", "x"]), "", parents, i))
    return out


def test_random_histories(spark):
    rng = random.Random(5)
    commits, tags, heads = [], [], []
    for k in range(30):
        repo = f"r{k}"
        own = history(rng, repo, rng.choice([1, 2, 30, 60]), rng.choice([0.0, 0.3, 0.9]))
        commits += own
        names = [c[2] for c in own]
        if k % 5:
            tags += [(repo, rng.choice(["v", "rc"]) + f"1.{j}.0", rng.choice(names)) for j in range(6)]
        heads += [(repo, rng.choice(names[-5:]))] + ([(repo, rng.choice(names))] if k % 4 == 0 else [])
    # A shallow clone, a root without an array, a repo without heads, tags that name nothing.
    commits.append(("cut", datetime(2024, 1, 1), "a", "feat: x", "", ["missing"], 0))
    commits.append(("cut", datetime(2023, 1, 1), "b", "fix: y", "", ["a", "missing"], 1))
    commits.append(("root", datetime(2023, 1, 1), "a", "fix: y", "", None, 0))
    commits.append(("headless", datetime(2023, 1, 1), "a", "fix: y", "", [], 0))
    heads += [("cut", "b"), ("root", "a"), ("root", "nothing"), ("nowhere", "a")]
    tags += [("cut", "v1.0.0", "a"), ("root", "v1.0.0", "nothing"), ("headless", "v1.0.0", "a")]
    rows = [spark.createDataFrame(r, k) for r, k in zip((commits, tags, heads), KINDS, strict=True)]
    want, nearest = by_hand(commits, tags, heads)
    assert values(release.commits_since_tag(*rows), "repo", "hash") == want
    got = {r.repo: r.version for r in release.next_versions_by_tag(*rows).collect()}
    assert got == nearest
    assert got["cut"] == "v1.0.0" and "root" not in got


def test_side_branch_with_older_time(spark):
    """A branch begun before the release and merged after it is pending; by time it isn't."""
    day = lambda d: datetime(2024, 1, d)
    commits = [
        ("r", day(1), "base", "fix: one", "", [], 0),
        ("r", day(2), "side", "feat: early work", "", ["base"], 1),
        ("r", day(5), "released", "fix: two", "", ["base"], 2),
        ("r", day(9), "merge", "merge side", "", ["released", "side"], 3),
    ]
    tags = [("r", "v1.4.2", "released")]
    rows = [spark.createDataFrame(r, k) for r, k in zip((commits, tags, [("r", "merge")]), KINDS, strict=True)]
    assert values(release.commits_since_tag(*rows), "hash") == [("merge",), ("side",)]
    assert values(release.next_versions_by_tag(*rows)) == [("r", "v1.4.2", "minor", "1.5.0")]


def test_empty_tables(spark):
    rows = [spark.createDataFrame([], k) for k in KINDS]
    assert release.commits_since_tag(*rows).count() == 0
    assert release.next_versions_by_tag(*rows).count() == 0


def test_rounds_carry_whole_numbers_only(spark, monkeypatch):
    """Texts are stored when commits are numbered and when they are placed, however long the history."""
    stored, real = [], ancestry.Rounds.store
    monkeypatch.setattr(ancestry.Rounds, "store", lambda self, df, *replaced: stored.append(df.dtypes) or real(self, df, *replaced))
    line = [("r", datetime(2024, 1, 1), f"h{i}", [f"h{i - 1}"] if i else []) for i in range(40)]
    commits = spark.createDataFrame(line, "repo string, ts timestamp, hash string, parents array<string>")
    heads = spark.createDataFrame([("r", "h39")], "repo string, hash string")
    placed = ancestry.chains(commits, heads, ancestry.Rounds(spark, "test"))
    assert values(placed, "hash", "chain", "depth") == values(spark.createDataFrame([(f"h{i}", "h39", i) for i in range(40)]))
    texts = [x for x in stored if any(kind != "bigint" for _, kind in x)]
    assert len(stored) >= 8 and len(texts) == 2
