"""Identifiers and endpoints of ordinary connection files are linked with the secret beside them."""

from parcelgrid.llm import secrets

VALUE = "Zx9Abcdefghij0123456Q"


def test_names_in_any_case_prefixes_and_schemes(spark):
    want = {
        "AZURE_CLIENT_ID: planner-77": ["link_id"], "Client_Id: planner-77": ["link_id"], "my_client_id=planner77": ["link_id"],
        "azure_client_id=Planner77ab": ["link_id"], "AccessKeyId: planner77": ["link_id"],
        "postgres://db.internal/plans": ["link_endpoint"], "amqp://queue:5672/x": ["link_endpoint"], "s3://bucket/part": ["link_endpoint"],
        "HTTPS://db.example.net/v1": ["link_endpoint"], "db.example.net:5432": ["link_endpoint"], "10.0.0.7:6379": ["link_endpoint"],
        "https://db.example.net/?client_id=planner77": ["link_endpoint"], "nothing to see": [],
    }
    texts = [(k, f"{part}\n{VALUE}") for k, part in enumerate(want)]
    got = dict(secrets.find_secrets(spark.createDataFrame(texts, "message_id int, content string")).collect())
    for k, (part, kinds) in enumerate(want.items()):
        assert [secrets.KINDS[s.kind] for s in got[k]] == kinds + ["link_value"] * bool(kinds), part
        assert not kinds or got[k][-1].start == len(part) + 1


def test_names_alone_are_not_reported(spark):
    texts = [(1, "AZURE_CLIENT_ID: planner-77"), (2, "azure_client_id=Planner77ab"), (3, "postgres://db.internal/plans db.example.net:5432")]
    assert not any(r.spans for r in secrets.find_secrets(spark.createDataFrame(texts, "message_id int, content string")).collect())
