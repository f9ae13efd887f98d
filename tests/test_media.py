"""Any-depth search of media objects: order, depth and shapes, without Python workers."""

import json
import random

from segue.operators import pages


def plain(node):
    if isinstance(node, dict):
        info = node.get("video_info")
        if isinstance(info, dict) and isinstance(info.get("variants"), list):
            return node
        node = [node[k] for k in sorted(node)]
    for child in node if isinstance(node, list) else ():
        found = plain(child)
        if found is not None:
            return found
    return None


def grown(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, "x", None, True, "{", 2.5])
    if kind < 0.35:
        return {"video_info": {"variants": rng.choice([[], [1], 3, None])}, "k": rng.randrange(1000)}
    if kind < 0.7:
        return {rng.choice("abcdeABé") + str(k): grown(rng, depth - 1) for k in range(rng.randrange(1, 4))}
    return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_deep_search_equals_recursion(spark):
    rng = random.Random(4)
    docs = [grown(rng, rng.randrange(1, 9)) for _ in range(400)]
    texts = [json.dumps(d) for d in docs] + [None, "", "{broken", "[]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").repartition(3)
    found = pages.find_media_node(df)
    got = {r.id: r.media and json.loads(r.media) for r in found.collect()}
    want = {k: plain(d) for k, d in enumerate(docs)} | {k: None for k in range(400, 404)}
    assert got == want and sum(v is not None for v in want.values()) > 50
    assert "Python" not in found._jdf.queryExecution().toString()
