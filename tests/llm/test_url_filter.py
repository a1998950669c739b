"""The URL filter against a tree of plain Python objects, and odd URLs."""

import math
import random
import re

from tidewater.llm import url_filter as u

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SCHEMA = "page_id long, url string, host string, path string, n string, segment string, template string"


def frame(spark, urls):
    rows = [(*x, "x", "x", "x", "x", "x") if isinstance(x, tuple) else (i, x, "x", "x", "x", "x", "x") for i, x in enumerate(urls)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rules(spark):
    return spark.createDataFrame(RULES, u.RULES)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(-len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fits)[1:] if fits else (None, None)


class Node:
    def __init__(self):
        self.next, self.n, self.good, self.bad, self.ended = {}, 0, 0, 0, 0

    def add(self, other):
        for k in ("n", "good", "bad", "ended"):
            setattr(self, k, getattr(self, k) + getattr(other, k))
        for s, child in other.next.items():
            self.next.setdefault(s, Node()).add(child)


def far(a, na, b, nb):
    return bool(na and nb) and abs(a / na - b / nb) >= math.sqrt(0.5 * math.log(2 / u.ALPHA)) * (na**-0.5 + nb**-0.5)


def plain(urls):
    """host, path, rule, verdict, template of each URL, by one recursive tree for each host."""
    places = [split(x) for x in urls]
    hosts = {}
    for host, path in places:
        segments = re.sub("[0-9]+", "#", path).split("/")
        segments = segments if len(segments) <= u.DEPTH + 1 else [*segments[: u.DEPTH], "*"]
        hosts.setdefault(host, []).append((segments, rule_of(host, path)[1]))
    judged = {}
    bad = sum(v == "block" for x in hosts.values() for _, v in x)
    good = sum(v == "allow" for x in hosts.values() for _, v in x)
    for host, members in hosts.items():
        root = Node()

        def grow(node, members, level):
            for segments, verdict in members:
                node.n += 1
                node.good += verdict == "allow"
                node.bad += verdict == "block"
                node.ended += len(segments) == level
            further = [m for m in members if len(m[0]) > level]
            counts = {}
            for segments, _ in further:
                counts[segments[level]] = counts.get(segments[level], 0) + 1
            groups = {}
            for m in further:
                c = counts[m[0][level]]
                groups.setdefault(m[0][level] if level == 0 or (c >= u.LEAST and c >= u.SHARE * len(further)) else "*", []).append(m)
            for s, part in groups.items():
                node.next[s] = Node()
                grow(node.next[s], part, level + 1)

        grow(root, members, 0)
        renamed = {}

        def compare(node, path):
            if path:
                taken = []
                for s, child in sorted(node.next.items(), key=lambda x: (-x[1].n, x[0])):
                    sums = {k: c.n for k, c in child.next.items()}
                    for t, group in taken:
                        if far(child.bad, child.good + child.bad, group["bad"], group["good"] + group["bad"]) or far(child.ended, child.n, group["ended"], group["n"]):
                            continue
                        if any(far(sums.get(k, 0), child.n, group["next"].get(k, 0), group["n"]) for k in {*sums, *group["next"]}):
                            continue
                        renamed[(*path, s)] = t
                        for k in ("n", "good", "bad", "ended"):
                            group[k] += getattr(child, k)
                        group["next"] = {k: sums.get(k, 0) + group["next"].get(k, 0) for k in {*sums, *group["next"]}}
                        break
                    else:
                        taken.append((s, {"n": child.n, "good": child.good, "bad": child.bad, "ended": child.ended, "next": sums}))
            for s, child in node.next.items():
                compare(child, (*path, s))

        compare(root, ())
        pooled = Node()

        def pool(node, path, into):
            for k in ("n", "good", "bad", "ended"):
                setattr(into, k, getattr(into, k) + getattr(node, k))
            for s, child in node.next.items():
                pool(child, (*path, s), into.next.setdefault(renamed.get((*path, s), s), Node()))

        pool(root, (), pooled)
        judged[host] = (root, renamed, pooled)
    out = []
    for host, path in places:
        root, renamed, pooled = judged[host]
        segments = re.sub("[0-9]+", "#", path).split("/")
        segments = segments if len(segments) <= u.DEPTH + 1 else [*segments[: u.DEPTH], "*"]
        share = (bad + 1) / (bad + good + 2) if bad + good else 0.0
        node, target, seen, names = root, pooled, (), []
        for s in segments:
            s = s if s in node.next else "*"
            seen, node = (*seen, s), node.next[s]
            names.append(renamed.get(seen, s))
            target = target.next[names[-1]]
            share = (target.bad + u.WEIGHT * share) / (target.good + target.bad + u.WEIGHT)
        rule, verdict = rule_of(host, path)
        out.append((host, path, rule, verdict or ("block" if share > u.BLOCKED else "allow"), "/".join(names)))
    return out


def agrees(spark, urls):
    found = sorted(u.filter_urls(frame(spark, urls), rules(spark)).collect(), key=lambda r: r["page_id"])
    assert [(r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in found] == plain(urls)
    return found


def test_random_sites(spark):
    r = random.Random(1)
    urls = []
    for host in ("a.example.com", "B.com", "x.net", "example.org", "deep.example.org", "com", "myexample.org", "org.evil"):
        for _ in range(r.choice([3, 40, 300])):
            lang = r.choice(["en", "en", "fr", "de", "es", "shop"])
            tail = r.choice([str(r.randint(0, 9999)), f"{r.randint(0, 99)}.html", f"post-{r.choice('abcdefghijklmnopqrstuvwxyz')}{r.choice('abcdefghijklmnop')}", "about", ""])
            urls.append(f"http{r.choice(['', 's'])}://{host}/{lang}/{tail}{r.choice(['', '/', '?q=/a/b', '#top'])}")
    urls += [f"http://casino.com/promo/{i}" for i in range(50)] + [f"http://casino.com/de/{i}" for i in range(200)] + [f"http://casino.com/en/{i}" for i in range(60)]
    found = agrees(spark, urls)
    assert {x["verdict"] for x in found if x["rule"] is None} == {"allow", "block"}


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "x://", "http://A.ORG", "http://A.org/", "http://ÄB.com/fr/", "http://h.com?x://y/de/", "http://h.com#/de/", "http://h.com/a://b/c", "http://h.com//de//", "http://com/fr/", "http://h.com:80/de/1", "http://h.net/*/#x", "http://h.net/" + "a/" * 40, "http://h.net/" + "b" * 200_000 + "/1", "mailto:a\n://b.org/\nq?z"]
    agrees(spark, urls)
    agrees(spark, urls * 4)


def test_repeated_ids_and_empty_table(spark):
    found = u.filter_urls(frame(spark, [(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.net/x"), (None, None)]), rules(spark)).collect()
    assert len(found) == 4 and sum(r["page_id"] is None for r in found) == 2
    assert u.filter_urls(frame(spark, []), rules(spark)).count() == 0
    none = spark.createDataFrame([], u.RULES)
    assert {(r["rule"], r["verdict"]) for r in u.filter_urls(frame(spark, ["http://a.org/x", "http://b.com/de/1"]), none).collect()} == {(None, "allow")}
