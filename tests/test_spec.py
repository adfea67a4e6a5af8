import json

import pytest

from millrace.plans import spec
from millrace.plans.spec import REDACTED, SpecError

FORM = {
    "jobName": "meter readings",
    "sources": [
        {
            "sourceTopic": "meters.in",
            "sourceBootstrapServers": "broker-1:9093",
            "sourceGroupId": "readers",
            "sourceAuthType": "SASL_SSL",
            "sourceUsername": "u",
            "sourcePassword": "p",
            "sourceMechanism": "PLAIN",
            "sourceStartingOffset": "EARLIEST",
            "sourceAlias": "m",
            "sourceSchema": '{"properties":{"meter":{"type":"integer"}}}',
            "sourceFormat": "JSON",
            "enableWatermark": True,
            "watermarkMode": "EXISTING",
            "watermarkColumn": "read_at",
        },
        {"sourceTopic": "homes", "sourceBootstrapServers": "broker-2:9093", "sourceAuthType": "NONE"},
    ],
    "sqlQuery": "SELECT meter FROM source_table_0",
    "targetTopic": "meters.out",
    "targetBootstrapServers": "broker-1:9093",
    "targetFormat": "JSON",
}


def test_form_defaults():
    job = spec.from_form(FORM)
    assert [s.table_name for s in job.sources] == ["source_table_0", "source_table_1"]
    assert job.sources[0].alias == "m"
    assert job.sources[0].watermark.max_out_of_orderness == 5000
    assert job.sources[0].kafka.authentication.mechanism == "PLAIN"
    assert job.sources[1].kafka.authentication is None
    assert job.sources[1].schema is None
    assert job.sources[1].watermark.strategy == "NONE"
    assert job.transformation.result_table_name == "result_table"
    assert job.engine.checkpoint_interval == 60_000
    assert job.target.type == "KAFKA"


def test_form_result_table_and_window():
    job = spec.from_form({**FORM, "resultTableName": "r", "checkpointInterval": 300000}, {}, {"sinkType": "LOG"})
    assert job.transformation.result_table_name == "r"
    assert job.audit.sink_type == "LOG" and job.audit.destination == "audit-events"
    assert job.reconciliation.window == "5m"


def test_round_trip_is_lossless_and_redaction_covers_every_secret():
    job = spec.from_form(
        {
            **FORM,
            "targetAuthType": "SASL_PLAINTEXT",
            "targetPassword": "secret",
            "targetJaasConfig": "jaas",
            "targetTruststorePassword": "ts",
            "checkpointDir": "/cp",
            "transformationType": "INLINE",
        }
    )
    assert spec.load(spec.dump(job, redact=False)) == job
    text = json.dumps(spec.dump(job))
    assert "secret" not in text and "jaas\"" not in text.replace("jaasConfig", "") and '"ts"' not in text
    assert text.count(REDACTED) == 4
    assert spec.load(json.loads(text)).engine.checkpoint_dir == "/cp"


def test_snake_and_camel_case():
    base = {
        "sources": [{"files": {"path": "/x"}}],
        "transformation": {"sqlContent": "SELECT 1"},
        "target": {"type": "FILE", "path": "/y"},
    }
    snake = {**base, "job_name": "j", "transformation": {"sql_content": "SELECT 1"}}
    assert spec.load({**base, "jobName": "j"}) == spec.load(snake)


@pytest.mark.parametrize(
    "change",
    [
        {"sources": []},
        {"sources": [{"tableName": "a"}]},
        {"sources": [{"files": {"path": "/x"}, "tableName": "a"}, {"files": {"path": "/y"}, "tableName": "a"}]},
        {"target": {"type": "CARRIER_PIGEON"}},
        {"unknown": 1},
        {"target": {"topic": "misplaced"}},
    ],
)
def test_bad_jobs(change):
    good = {
        "jobName": "j",
        "sources": [{"files": {"path": "/x"}}],
        "transformation": {"sqlContent": "SELECT 1"},
        "target": {"type": "FILE", "path": "/y"},
    }
    spec.load(good)
    with pytest.raises(SpecError):
        spec.load({**good, **change})


@pytest.mark.parametrize(
    "ms, label",
    [
        (3 * 86_400_000, "3d"),
        (25 * 3_600_000, "25h"),
        (61 * 60_000, "61m"),
        (61_000, "61s"),
        (999, "0s"),
        (-60_000, "n/a"),
    ],
)
def test_interval_label(ms, label):
    assert spec.interval_label(ms) == label


def test_environment_references(monkeypatch):
    monkeypatch.setenv("MILLRACE_TEST_PASSWORD", "pw")
    assert spec.from_environment("${MILLRACE_TEST_PASSWORD}!") == "pw!"
    assert spec.from_environment(None) is None
    with pytest.raises(SpecError):
        spec.from_environment("${MILLRACE_TEST_UNSET}")


def test_schema_flags():
    assert not spec.Schema().has_definition and not spec.Schema(definition="").has_definition
    assert spec.Schema(definition="{}").has_definition
    assert spec.Schema(type="registry", registry_url="http://r").uses_registry
    assert not spec.Schema(type="REGISTRY").uses_registry and not spec.Schema(type="JSON").uses_registry
