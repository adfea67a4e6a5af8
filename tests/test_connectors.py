import pytest

from millrace.plans import sinks
from millrace.plans.spec import Audit, Auth, Kafka, Reconciliation, Schema, Source, SpecError, Target
from millrace.sources import connectors

KAFKA = dict(topic="t", bootstrap_servers="b:9092")


@pytest.mark.parametrize(
    "kafka, expected",
    [
        ({}, "earliest"),
        ({"starting_offset": "LATEST"}, "latest"),
        ({"starting_offset": "GROUP_OFFSETS"}, "earliest"),
        ({"starting_offset": "whatever"}, "earliest"),
        ({"startup_mode": "latest-offset"}, "latest"),
        ({"startup_mode": "earliest-offset", "starting_offset": "LATEST"}, "earliest"),
        ({"startup_mode": "unknown", "starting_offset": "LATEST"}, "earliest"),
        ({"startup_mode": "group-offsets"}, "earliest"),
        ({"startup_mode": "timestamp"}, "earliest"),
        ({"starting_offset": "TIMESTAMP"}, "earliest"),
    ],
)
def test_start_positions(kafka, expected):
    assert connectors.start_options(Kafka(**KAFKA, **kafka), streaming=True) == {"startingOffsets": expected}


def test_start_by_timestamp():
    options = connectors.start_options(
        Kafka(**KAFKA, startup_mode="timestamp", starting_offset_timestamp=17), streaming=True
    )
    assert options == {"startingTimestamp": "17", "startingOffsetsByTimestampStrategy": "latest"}


def test_bounded_read_cannot_start_at_the_end():
    with pytest.raises(SpecError):
        connectors.start_options(Kafka(**KAFKA, starting_offset="LATEST"), streaming=False)


def test_unknown_mechanisms_and_quotes():
    for wrong in (Auth("SASL_SSL", "GSSAPI", "u", "p"), Auth("SASL_SSL", "PLAIN", None, "p"), Auth("SASL_SSL", "PLAIN", "u")):
        with pytest.raises(SpecError):
            connectors.security_options(wrong)
    entry = connectors.security_options(Auth("sasl_plaintext", "scram-sha-512", 'a"b', "c\\d"))["kafka.sasl.jaas.config"]
    assert entry.endswith('ScramLoginModule required username="a\\"b" password="c\\\\d";')


def test_security_options():
    plain = connectors.security_options(Auth("SASL_PLAINTEXT", "PLAIN", "u", "p"))
    assert plain["kafka.security.protocol"] == "SASL_PLAINTEXT"
    assert plain["kafka.sasl.jaas.config"] == (
        'org.apache.kafka.common.security.plain.PlainLoginModule required username="u" password="p";'
    )
    scram = connectors.security_options(
        Auth("SASL_SSL", "SCRAM-SHA-256", "u", "p", truststore_location="/ts", truststore_password="x")
    )
    assert "ScramLoginModule" in scram["kafka.sasl.jaas.config"]
    assert scram["kafka.ssl.truststore.location"] == "/ts" and scram["kafka.ssl.truststore.password"] == "x"
    assert connectors.security_options(Auth("SASL_SSL", "PLAIN", jaas_config="own"))["kafka.sasl.jaas.config"] == "own"
    assert connectors.security_options(None) == connectors.security_options(Auth("NONE")) == {}


def test_read_options():
    options = connectors.read_options(Kafka(**KAFKA, group_id="g", properties={"max.poll.records": 500}), True, 4)
    assert options["subscribe"] == "t" and options["kafka.bootstrap.servers"] == "b:9092"
    assert options["kafka.max.poll.records"] == "500" and options["kafka.group.id"] == "g"
    assert options["minPartitions"] == "4"
    own = connectors.read_options(Kafka(**KAFKA, options={"minPartitions": 9, "maxOffsetsPerTrigger": 100}), True, 4)
    assert own["minPartitions"] == "9" and own["maxOffsetsPerTrigger"] == "100"
    with pytest.raises(SpecError):
        connectors.read_options(Kafka(topic="t"), True)


def test_kafka_package_is_named_when_absent(spark):
    with pytest.raises(SpecError, match="spark-sql-kafka"):
        connectors.read(spark, Source(table_name="x", kafka=Kafka(**KAFKA)), streaming=False)


def test_message_formats(spark):
    rows = spark.range(1).selectExpr("id", "cast(null as string) AS s")
    as_json = connectors.messages(rows, Target(kafka=Kafka(**KAFKA, format="JSON"))).first()[0]
    assert as_json == '{"id":0,"s":null}'
    as_text = connectors.messages(rows, Target(kafka=Kafka(**KAFKA))).first()[0]
    assert as_text == "+I[0, null]"
    fallback = connectors.messages(rows, Target(kafka=Kafka(**KAFKA, format="AVRO"), schema=Schema(""))).first()[0]
    assert fallback == as_text


@pytest.mark.parametrize(
    "config, expected",
    [
        (None, "LOG"),
        (Audit(sink_type=None), "LOG"),
        (Audit(sink_type="log"), "LOG"),
        (Audit(sink_type="carrier"), "LOG"),
        (Audit(sink_type="KAFKA"), "LOG"),
        (Audit(sink_type="JDBC", connection=""), "LOG"),
        (Audit(sink_type="kafka", connection="b:9092"), "KAFKA"),
        (Audit(sink_type="jdbc", connection="jdbc:x"), "JDBC"),
        (Reconciliation(), "LOG"),
        (Reconciliation(sink_type="JDBC"), "LOG"),
        (Reconciliation(sink_type="JDBC", connection="jdbc:x"), "JDBC"),
        (Reconciliation(sink_type="KAFKA", connection="b"), "KAFKA"),
    ],
)
def test_sink_type(config, expected):
    assert sinks.sink_type(config) == expected


def test_sink_options():
    kafka = sinks.kafka_options(Audit(connection="b:9092", kafka_auth=Auth("SASL_SSL", "PLAIN", "u", "p")))
    assert kafka["topic"] == "audit-events" and kafka["kafka.acks"] == "1" and kafka["kafka.linger.ms"] == "50"
    assert "kafka.sasl.jaas.config" in kafka
    jdbc = sinks.jdbc_options(Reconciliation(connection="jdbc:x", username="u", password="p"))
    assert jdbc == {"url": "jdbc:x", "dbtable": "reconciliation-reports", "user": "u", "password": "p"}
    target = Target(type="JDBC", connection="jdbc:x", table="t", username="u")
    assert connectors.jdbc_options(target) == {"url": "jdbc:x", "dbtable": "t", "user": "u"}
    with pytest.raises(SpecError):
        connectors.jdbc_options(Target(type="JDBC", table="t"))


def test_a_failing_sink_is_swallowed(spark):
    from millrace.operators import audit

    rows = audit.events_frame(spark, [audit.event("r", "j", audit.JOB_SUBMITTED)])
    assert sinks.emit(rows, Audit(sink_type="KAFKA", connection="nowhere:1")) is False
    assert sinks.emit(rows, Audit()) is True
