"""The expanded corpus against a loop over candidates in digest order."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.plans import corpora


def row(i, source, country, number, road, city, joint=", "):
    text, spans = "", []
    for label, raw in (("house_number", number), ("road", road), ("city", city)):
        if raw:
            text += joint if text else ""
            spans.append({"label": label, "start": len(text), "end": len(text) + len(raw), "raw": raw})
            text += raw
    return {"id": i, "source": source, "country": country, "text": text, "components": spans}


def drawn(n, seed, prefix):
    r = random.Random(seed)
    out = [row(f"{prefix}{i}", r.choice("ab"), r.choice(["us", "jp"]), r.choice(["", "", *map(str, range(1, 9))]), f"Road {r.choice('PQRSTUVW')}{r.randrange(4)}", f"Town {r.randrange(6)}", r.choice([", ", " "])) for i in range(n)]
    for x in out[::17]:  # the same text under other labels
        x["components"] = [s | {"label": "suburb" if s["label"] == "city" else s["label"]} for s in x["components"]]
    return out


def loop(rows, train, kept_out, caps, per_group):
    """rows carry loose, grp, streets, sign and bad."""
    signs = {}
    for x in rows:
        signs.setdefault(x.loose, set()).add(x.sign)
    old = {}
    for x in train:
        old.setdefault(x.loose, set()).add(x.sign)
    ids, groups = {x.loose for x in kept_out}, {x.grp for x in kept_out}
    streets = {k for x in kept_out for k in x.streets}
    old_groups, old_streets = {x.grp for x in train}, {k for x in train for k in x.streets}
    seen, quotas, taken, reasons, splits = set(), Counter(), Counter(), {}, {}
    for x in sorted(rows, key=lambda x: hashlib.sha256(x.id.encode()).hexdigest()):
        full = {"house_number", "road"} <= {c.label for c in x.components}
        quota = (x.source, x.country, full)
        if x.bad:
            why = x.bad
        elif len(signs[x.loose]) > 1:
            why = "conflicting-candidate-labels"
        elif x.loose in old:
            why = "existing-training-duplicate" if old[x.loose] == {x.sign} else "conflict-with-existing-training"
        elif x.loose in ids or x.grp in groups or set(x.streets) & streets:
            why = "protected-evaluation-overlap"
        elif x.loose in seen:
            why = "new-source-duplicate"
        else:
            seen.add(x.loose)
            why = "mixture-or-street-cap" if quotas[quota] >= caps[not full] or taken[x.grp] >= per_group else None
        reasons[x.id] = why
        if why is None:
            quotas[quota] += 1
            taken[x.grp] += 1
            ours = x.grp in old_groups or set(x.streets) & old_streets or int(x.grp[:8], 16) % 10
            splits[x.id] = "train" if ours else "source-dev"
    held = [x for x in rows if splits.get(x.id) == "source-dev"]
    groups, streets = {x.grp for x in held}, {k for x in held for k in x.streets}
    for x in rows:
        if splits.get(x.id) == "train" and (x.grp in groups or set(x.streets) & streets):
            reasons[x.id] = "supplementary-holdout-overlap"
            del splits[x.id]
    return {i: (splits.get(i), why) for i, why in reasons.items()}


def test_expanded_build(spark):
    schema = f"id string, source string, country string, text string, components {S.SPANS}"
    bad = [{"id": "bad", "source": "a", "country": "us", "text": None, "components": []}, {"id": "odd", "source": "a", "country": "us", "text": "x�", "components": []}]
    c, old, out = (spark.createDataFrame(x, schema).cache() for x in (drawn(600, 1, "c") + bad, drawn(40, 2, "t"), drawn(12, 3, "p")))
    caps, per_group = (60, 25), 3
    decided, made = corpora.expanded_build(c, old, out, caps, per_group)
    got = {r.id: (r.split, r.reason) for r in decided.collect()}
    audited = corpora.keyed(corpora.corpus.audit(c).withColumnRenamed("reason", "bad")).collect()
    want = loop(audited, corpora.keyed(old).collect(), corpora.keyed(out).collect(), caps, per_group)
    assert got == want and len(got) == 602
    assert {why for _, why in want.values()} >= {None, "missing-text", "conflicting-candidate-labels", "existing-training-duplicate", "protected-evaluation-overlap", "new-source-duplicate", "mixture-or-street-cap"}

    made = made.collect()
    train = {i for i, (split, _) in want.items() if split == "train"}
    assert {r.origin for r in made} <= train and {r.id for r in made if r.kind == "original"} <= train
    assert all(r.text[s.start : s.end] == s.raw for r in made for s in r.components)
    closed = {x.loose for x in corpora.keyed(out).collect()} | {x.loose for x in audited if want[x.id][0] == "source-dev"}
    signs = {}
    for x in corpora.keyed(spark.createDataFrame([r.asDict(recursive=True) for r in made], f"id string, origin string, kind string, country string, text string, components {S.SPANS}")).collect():
        signs.setdefault(x.loose, set()).add(x.sign)
    assert not closed & set(signs) and all(len(s) == 1 for s in signs.values())
    assert len(made) > len(train)


def test_compacted_additions_and_empty_tables(spark):
    schema = f"id string, source string, country string, text string, components {S.SPANS}"
    one = {"id": "j", "source": "a", "country": "jp", "text": "東 京 1", "components": [{"label": "city", "start": 0, "end": 3, "raw": "東 京"}, {"label": "house_number", "start": 4, "end": 5, "raw": "1"}]}
    got = {r.kind: r for r in corpora.additions(spark.createDataFrame([one], schema)).collect() if r.kind in ("original", "compact")}
    assert got["compact"].text == "東京 1" and [s.raw for s in got["compact"].components] == ["東京", "1"] and got["compact"].origin == "j"
    none = spark.createDataFrame([], schema)
    decided, made = corpora.expanded_build(none, none, none)
    assert decided.withColumn("x", F.lit(1)).count() == made.count() == 0
