"""Random strings without a digit or of fewer than 20 characters are found by the models; ordinary words aren't."""

import random
import string

from tidewake.llm import secrets

SF = "/root/testdata/sf0.01"


def test_op1_digits_and_length(spark):
    rnd = random.Random(11)
    ratios = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    kinds = [(string.ascii_letters, 32), (string.ascii_letters, 20), (string.ascii_letters + string.digits, 12)]
    runs = [["".join(rnd.choices(a, k=n)) for _ in range(200)] for a, n in kinds]
    data = [(i, f"see {r} here") for i, r in enumerate(r for k in runs for r in k)] + [(10**6, "thatingblere ereshtionand, an_ordinary_identifier 2024-01-02-03-04-05")]
    found = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(data, "doc_id long, text string"), ratios=ratios).collect()}
    for k, (_, n) in enumerate(kinds):
        assert sum(found[200 * k + i] == f"markov:4:{4 + n}" for i in range(200)) >= 180
    assert found[10**6] == ""
