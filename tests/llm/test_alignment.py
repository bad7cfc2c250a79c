import random

import pytest

from quire.llm import alignment as A
from quire.llm import wrapper


def table_matching(a, b, i=0, j=0):
    """Simple tree matching by the quadratic table."""
    if a.keys[i] != b.keys[j]:
        return 0
    left, right = a.children()[i], b.children()[j]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for x, u in enumerate(left, 1):
        for y, v in enumerate(right, 1):
            best[x][y] = max(best[x - 1][y], best[x][y - 1], best[x - 1][y - 1] + table_matching(a, b, u, v))
    return 1 + best[-1][-1]


def skeleton(r, n):
    out = A.Skeleton(["#root"], [-1])
    for _ in range(n):
        parent = r.randrange(len(out.keys))
        key = r.choice("abcdef")
        if all(p != parent or k != key for k, p in zip(out.keys, out.parents, strict=True)):
            out.add(key, parent)
    return out


def test_matching_is_the_best():
    r = random.Random(1)
    for _ in range(400):
        a, b = skeleton(r, r.randint(0, 14)), skeleton(r, r.randint(0, 14))
        pairs = A.matched(a, b)
        assert len(pairs) == table_matching(a, b)
        assert all(a.keys[i] == b.keys[j] and (i == 0 or pairs[a.parents[i]] == b.parents[j]) for i, j in pairs.items())
        for own in a.children():
            to = [pairs[c] for c in own if c in pairs]
            assert to == sorted(to)


def test_templates_grow():
    r = random.Random(2)
    for _ in range(100):
        a, b = skeleton(r, 8), skeleton(r, 8)
        grown = A.merged(b, a, A.matched(a, b))
        assert len(A.matched(b, grown)) == len(b.keys) and len(A.matched(a, grown)) >= len(A.matched(a, b))
        assert A.Skeleton.decoded(grown.encoded()) == grown
        assert all(len({grown.keys[c] for c in own}) == len(own) for own in grown.children())
    wide = A.Skeleton(["#root", *(f"k{i}" for i in range(20_000))], [-1] + [0] * 20_000)
    assert len(A.matched(wide, wide)) == 20_001


def say(r, low, high):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.randint(low, high)))


def page(r, host):
    """A page of which every text varies, and whose names say nothing."""
    links = "".join(f"<li><a href=x>{say(r, 1, 2)}</a></li>" for _ in range(r.randint(2, 9)))
    body = "".join(f"<p>{say(r, 0, 80)}</p>" for _ in range(r.randint(1, 6)))
    extra = f"<div class=q{host}>{say(r, 1, 8)}</div>" if r.random() < 0.4 else ""
    title = say(r, 3, 6)
    html = f"<html><body><div class=x{host}><ul>{links}</ul></div>{extra}<div class=y{host}><h1>{title}</h1>{body}</div><div class=z{host}>{say(r, 3, 9)}</div></body></html>"
    return html, "\n\n".join([title, *filter(None, (p.split("</p>")[0].strip() for p in body.split("<p>")[1:]))])


def test_votes_alone_find_the_content(spark, monkeypatch):
    r = random.Random(3)
    rows, want = [], {}
    for host, n in enumerate((60, 20, 5)):
        for _ in range(n):
            html, text = page(r, host)
            rows.append((len(rows), f"http://h{host}.example/{len(rows)}", html))
            want[rows[-1][0]] = text
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in wrapper.main_text(frame).collect()} == want
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", 0)
    assert {x.page_id: x.text for x in wrapper.main_text(frame).collect()} == want
    # without the wrapper nothing tells these slots apart
    assert sum(wrapper.extract(html, None) == want[k] for k, _, html in rows) == 0


def test_lists_decide_nothing_where_pages_vote(monkeypatch):
    """Menus, adverts and footers under their usual names, but the lists don't know them: the votes do."""
    monkeypatch.setattr(wrapper, "DROPPED", wrapper.UNSEEN)
    monkeypatch.setattr(wrapper, "_names_region", lambda label: False)
    r = random.Random(4)

    def html(k):
        links = "".join(f"<li><a href=x>{say(r, 1, 2)}</a></li>" for _ in range(6))
        body = "".join(f"<p>{say(r, 1, 60)}</p>" for _ in range(4))
        return f"<html><body><nav><ul>{links}</ul></nav><div class=ad>{say(r, 2, 8)}</div><article><h1>T{k}</h1>{body}</article><footer>{say(r, 2, 9)}</footer></body></html>"

    pages = [html(k) for k in range(40)]
    own = wrapper.Wrapper(pages)
    for k, p in enumerate(pages):
        got = wrapper.extract(p, own)
        assert got.startswith(f"T{k}\n\n") and got.count("\n\n") == 4
        assert wrapper.extract(p, None).count("\n\n") > 4 or wrapper.extract(p, None) == got


@pytest.mark.parametrize("limit", [wrapper.BROADCAST_BYTES, 0])
def test_query_equals_one_host_after_the_other(spark, limit, monkeypatch):
    r = random.Random(5)
    hosts = {}
    for host in range(6):
        hosts[host] = [page(r, r.choice([host, 9]))[0] for _ in range(r.choice([1, 2, 3, 12]))]
        hosts[host] += [h.replace("<p>", f"<p>Fixed line of {host}.</p><p>", 1) for h in hosts[host][:2]] + [hosts[host][0], "", "<p>Other</p>"]
    rows = [(host * 100 + k, f"https://H{host}.example/{k}", h) for host, own in hosts.items() for k, h in enumerate(own)]
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", limit)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as _host", "1 as text", "2 as n_chars")
    got = {x.page_id: (x.text, x.n_chars) for x in wrapper.main_text(frame).collect()}
    for host, own in hosts.items():
        known = wrapper.Wrapper([h for h in own if h])
        for k, h in enumerate(own):
            text = wrapper.extract(h, known)
            assert got[host * 100 + k] == (text, len(text))
