import re
import unicodedata

from scriptorium.functions import text as T


def test_only_texts_that_may_change_go_to_python(spark):
    unstable = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", T.UNSTABLE))
    assert not unstable.search("café, naïve, Łódź, ǆ ʒ")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    parts = [x.split() for x in map(unicodedata.decomposition, every) if x and x[0] != "<"]
    joins = {chr(int(p[1], 16)) for p in parts if len(p) == 2} | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)}
    for c in every:
        if not unstable.match(c):
            assert not unicodedata.combining(c) and unicodedata.is_normalized("NFC", c) and c not in joins
    texts = ["cafe\u0301", "e\u0323\u0302", "\u212b", "\u1100\u1161\u11a8", "\uac00\u11a8", "か\u3099", "a", "é", "", None, "q\u0307\u0323", "\U0001d15e"]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select("k", T.composed("x").alias("y")).orderBy("k").collect()
    assert [r.y for r in got] == [x if x is None else unicodedata.normalize("NFC", x) for x in texts]
