"""The command line runs a report and writes it with Spark's writer."""

from __future__ import annotations

import os
import tempfile

import pytest

from pulseboard.cli import build_report, parser, source, write_stored
from pulseboard.params import as_datetime
from pulseboard.plans.catalog import REPORTS, _domain
from pulseboard.plans.stored import STORED_RUNS
from tests.conftest import SF001, rows


def test_cli_builds_the_registered_report(spark):
    args = parser().parse_args(
        ["daily_active_orgs", "--testdata", SF001, "--start", "2024-01-20", "--end", "2024-02-03",
         "--internal-pattern", "%7", "--exempt-org", "1",
         "--targets", "cs=BCS_CLICK,vr=VR_VIEW,dq=GRABBER_PURCHASE"]
    )
    df = build_report(args, _domain(spark, SF001))
    assert rows(df) == rows(REPORTS["daily_active_orgs"](spark, SF001))


def test_cli_writes_output(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="pulseboard-cli-"), "r9")
    args = parser().parse_args(
        ["error_counts", "--testdata", SF001, "--start", "2024-01-20", "--end", "2024-02-03",
         "--internal-pattern", "%7", "--exempt-org", "1",
         "--activities", "BCS_ERROR,GRABBER_ERROR,EXPORT_ERROR,VR_ERROR,LOGIN_ERROR", "--out", out]
    )
    build_report(args, _domain(spark, SF001)).write.mode("overwrite").parquet(out)
    assert sorted(rows(spark.read.parquet(out))) == sorted(rows(REPORTS["error_counts"](spark, SF001)))


def test_reports_from_counts_that_the_command_wrote(spark):
    counts = os.path.join(tempfile.mkdtemp(prefix="pulseboard-cli-"), "counts")
    here = ["--testdata", SF001, "--counts", counts]
    whole = parser().parse_args(["write_counts", *here])
    write_stored(whole, source(whole, spark))
    days = parser().parse_args(["write_counts", *here, "--start", "2024-01-10", "--end", "2024-01-11"])
    write_stored(days, source(days, spark))
    args = parser().parse_args(
        ["daily_active_orgs", *here, "--start", "2024-01-20", "--end", "2024-02-03", "--internal-pattern", "%7",
         "--exempt-org", "1", "--targets", "cs=BCS_CLICK,vr=VR_VIEW,dq=GRABBER_PURCHASE"]
    )
    domain = source(args, spark)
    assert rows(build_report(args, domain)) == rows(REPORTS["daily_active_orgs"](spark, SF001))
    assert "activity_counts" in domain.made
    with pytest.raises(ValueError, match="--counts"):
        write_stored(parser().parse_args(["write_counts", "--testdata", SF001]), domain)
    with pytest.raises(ValueError, match="both"):
        write_stored(parser().parse_args(["write_counts", *here, "--start", "2024-01-10"]), domain)


def test_organisations_from_sets_that_the_command_wrote(spark):
    sets = os.path.join(tempfile.mkdtemp(prefix="pulseboard-cli-"), "sets")
    rule = ["--internal-pattern", "%7", "--exempt-org", "1", "--targets", "cs=BCS_CLICK,vr=VR_VIEW,dq=GRABBER_PURCHASE"]
    args = parser().parse_args(["write_sets", "--testdata", SF001, "--sets", sets, *rule])
    write_stored(args, source(args, spark))
    for name in ("active_orgs_whole_days", "active_orgs_of_window"):
        report = name.replace("whole", "of")
        args = parser().parse_args([report, "--testdata", SF001, "--sets", sets, "--start", "2024-01-20", "--end", "2024-01-25", *rule])
        assert rows(build_report(args, source(args, spark))) == rows(STORED_RUNS[name](spark, SF001))
    with pytest.raises(ValueError, match="--sets"):
        args = parser().parse_args(["active_orgs_of_window", "--testdata", SF001, "--start", "2024-01-20", "--end", "2024-01-25"])
        build_report(args, source(args, spark))


def test_a_report_without_its_activities_is_refused(spark):
    args = parser().parse_args(["error_counts", "--testdata", SF001, "--start", "2024-01-20", "--end", "2024-02-03"])
    with pytest.raises(ValueError, match="--activities"):
        build_report(args, _domain(spark, SF001))


def test_groups_make_the_activity_list(spark):
    args = parser().parse_args(
        ["error_counts", "--testdata", SF001, "--start", "2024-01-20", "--end", "2024-02-03",
         "--internal-pattern", "%7", "--exempt-org", "1", "--group", "cards=BCS_CLICK+BCS_VIEW",
         "--group", "visits=VR_VIEW+VR_CLICK+BCS_VIEW", "--use-groups", "cards,visits"]
    )
    got = rows(build_report(args, _domain(spark, SF001)))
    assert sorted(got) == sorted(rows(REPORTS["error_counts_of_groups"](spark, SF001)))


def test_offsets_become_utc():
    assert as_datetime("2024-01-10T00:00:00+02:00").isoformat() == "2024-01-09T22:00:00"
    assert as_datetime("2024-01-10").isoformat() == "2024-01-10T00:00:00"
