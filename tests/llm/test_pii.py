"""Personal data against Python's regular expressions, and the added kinds."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemill.llm import pii

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (
                    kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    pick = random.Random(1)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "0001.02.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49.", "é", "😀", " ", "-", "x.y",
             "x@y.z@w.v", "a@b.c%d@e.f", "5", "99999999999999999999", "\n", "++1 22", "u_v+w@k-l.com"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 25))) for _ in range(400)]
    texts += [None, "", "7" * 50_000, "a" * 50_000, "a." * 20_000, "1." * 20_000, "+" * 9_000, ("1 " * 30_000) + "😀 a@b.de", "4111111111111111 " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("kind", F.lit(None).cast("string"))
    found = pii.find_personal_data(df)
    spans = F.filter("found", lambda x: x["kind"].isin(*KINDS))
    for row in found.select("doc_id", pii.joined(spans).alias("spans")).collect():
        assert row["spans"].split(",") == (base(texts[row["doc_id"]]) or [""]), texts[row["doc_id"]][:200]


def test_added_kinds_and_scores(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "konto: DE88370400440532013000"), (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789"), (5, "card 4111111111111111"),
            (6, "no word 4111111111111111"), (None, "GB82WEST12345698765432")]
    found = {r["doc_id"]: [(x["kind"], round(x["score"], 2)) for x in r["found"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1][-1] == ("iban", 1.0) and ("iban", 1.0) not in found[2] and found[3] == [("ssn", 0.45)] and found[4] == []
    assert found[5] == [("card", 1.0)] and found[6] == [("card", 0.8)] and found[None] == [("iban", 0.9)]
    assert pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_digest(spark):
    from tidemill.llm.queries import op6_pii
    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for row in op6_pii(spark, folder).collect():
        assert row["base_sha256"] == hashlib.sha256(",".join(base(texts[row["doc_id"]])).encode()).hexdigest()
