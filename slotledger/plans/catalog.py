"""The registered queries: every operator applied to inputs derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.functions.periods import resolve_period
from slotledger.functions.text import shift_list, to_int
from slotledger.operators import bookings as B
from slotledger.operators import calendar as C
from slotledger.operators import changes, employees, feedback, images, presence, report_requests, settings, spots, validation
from slotledger.operators import utilization as U
from slotledger.operators.replay import replay
from slotledger.plans import changefeed
from slotledger.plans import fixtures as X
from slotledger.schemas import LIST_SETTINGS, STORED_TABLES, Settings
from slotledger.session import checkpoint, shared_path, tune
from slotledger.sinks import state
from slotledger.sources import requests as R
from slotledger.sources import snapshot
from slotledger.streaming import follow, live

Query = Callable[[SparkSession, str], DataFrame]

REPORT = Settings(desks=28, parking=10, target_days=2)
WEEK_REF, MONTH_REF, LONG_MONTH_REF = "1998-02-11", "1998-02-10", "1998-03-10"
QUARTER_REF, YEAR_REF = "1998-02-10", "1998-06-01"
LOG_MONTH_REF = "2024-01-10"
VIEWER = "e_7"
PERIOD_NAMES = ("week", "month", "quarter", "year", "Week")

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), sf_dir)

    QUERIES[build.__name__] = run
    return build


def _period_bookings(spark: SparkSession, sf: str, period: str, ref: str) -> DataFrame:
    """The bookings of a report period, with its bounds in reach of the scan."""
    return X.bookings(spark, sf, *resolve_period(period, ref))


# ---- bookings and calendar --------------------------------------------------------------------------------------


@query
def bookings_flatten(spark: SparkSession, sf: str) -> DataFrame:
    days = B.flatten_bookings(B.nest_bookings(X.bookings_raw(spark, sf)))
    return B.with_dates(days).select("date", "date_raw", "shift", "kind", "slot", "user_id")


@query
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The bookings as they come back from the stored tables, and from day documents in one part and in three."""
    held = checkpoint(X.bookings_raw(spark, sf))
    columns = ("date", "date_raw", "shift", "kind", "slot", "user_id")
    tables = {name: spark.createDataFrame([], schema) for name, schema in STORED_TABLES.items()}
    state.write_tables(tables | {"bookings": held}, store := shared_path(spark, "tables"))
    state.write_day_documents(held, days := shared_path(spark, "days"))
    state.write_day_documents(held, parts := shared_path(spark, "parts"), parts=3)
    back = {
        "tables": snapshot.read_tables(spark, store)["bookings"],
        "days": state.read_day_documents(spark, days),
        "parts": state.read_day_documents(spark, parts),
    }
    first, *rest = [table.select(F.lit(name).alias("source"), *columns) for name, table in back.items()]
    for table in rest:
        first = first.unionByName(table)
    return first


@query
def store_after_log(spark: SparkSession, sf: str) -> DataFrame:
    """Bookings stored after the first half of the log, with the days written back that the second half touched."""
    first, second, _ = _cut(validation.valid_commands(X.commands(spark, sf)))
    text = F.date_format("date", "yyyy-MM-dd").alias("date_raw")
    columns = ("date", text, "shift", "kind", "slot", "user_id")
    tables = {name: spark.createDataFrame([], schema) for name, schema in STORED_TABLES.items()}
    tables["bookings"] = changes.settled_bookings(replay(first)).select(*columns)
    state.write_tables(tables, store := shared_path(spark, "store"))
    held = snapshot.read_tables(spark, store)["bookings"]
    outcomes = checkpoint(replay(second, held=held))
    touched = checkpoint(state.touched_dates(outcomes))
    left = changes.settled_bookings(outcomes, held=held).join(touched, "date", "left_semi").select(*columns)
    state.write_days(checkpoint(left), store, touched)
    return snapshot.read_tables(spark, store)["bookings"].select("date", "shift", "kind", "slot", "user_id")


@query
def bookings_applicable(spark: SparkSession, sf: str) -> DataFrame:
    return B.applicable(X.bookings(spark, sf))


@query
def bookings_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return B.dangling(X.bookings(spark, sf), X.employees(spark, sf))


@query
def day_grid(spark: SparkSession, sf: str) -> DataFrame:
    return B.day_grid(X.bookings(spark, sf))


@query
def day_image(spark: SparkSession, sf: str) -> DataFrame:
    return B.day_image(X.bookings_raw(spark, sf)).drop("slots")


@query
def calendar_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return C.span_calendar(X.table(spark, sf, "orders"), "o_orderdate")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """A report request for every order date and period name."""
    dates = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return dates.select(
        F.explode(F.array(*map(F.lit, PERIOD_NAMES))).alias("period"),
        F.date_format("date", "yyyy-MM-dd").alias("ref"),
    )


@query
def period_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return C.resolve_periods(_requests(spark, sf))


@query
def summary_requests(spark: SparkSession, sf: str) -> DataFrame:
    return report_requests.request_summaries(X.bookings(spark, sf), _requests(spark, sf), REPORT)


# ---- utilization ------------------------------------------------------------------------------------------------


@query
def util_shift(spark: SparkSession, sf: str) -> DataFrame:
    held = X.bookings(spark, sf)
    return U.shift_utilization(U.complete_counts(held, C.span_calendar(held)), REPORT)


def _summary(spark: SparkSession, sf: str, period: str, ref: str) -> DataFrame:
    return U.summary(_period_bookings(spark, sf, period, ref), X.employees(spark, sf), REPORT, period, ref)


@query
def summary_week(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "week", WEEK_REF)


@query
def summary_month(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "month", MONTH_REF)


@query
def summary_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "quarter", QUARTER_REF)


@query
def summary_year(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "year", YEAR_REF)


@query
def daily_week(spark: SparkSession, sf: str) -> DataFrame:
    return U.daily_by_shift(_period_bookings(spark, sf, "week", WEEK_REF), REPORT, WEEK_REF)


@query
def daily_month(spark: SparkSession, sf: str) -> DataFrame:
    return U.daily_means(_period_bookings(spark, sf, "month", MONTH_REF), REPORT, MONTH_REF)


@query
def weekly_agg(spark: SparkSession, sf: str) -> DataFrame:
    return U.weekly_means(_period_bookings(spark, sf, "month", MONTH_REF), REPORT, MONTH_REF)


@query
def monthly_agg_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return U.monthly_means(_period_bookings(spark, sf, "quarter", QUARTER_REF), REPORT, "quarter", QUARTER_REF)


@query
def monthly_agg_year(spark: SparkSession, sf: str) -> DataFrame:
    return U.monthly_means(_period_bookings(spark, sf, "year", YEAR_REF), REPORT, "year", YEAR_REF)


# ---- presence ---------------------------------------------------------------------------------------------------


@query
def presence_marks(spark: SparkSession, sf: str) -> DataFrame:
    return presence.presence_of_employees(X.bookings(spark, sf), X.employees(spark, sf))


@query
def presence_days(spark: SparkSession, sf: str) -> DataFrame:
    held = _period_bookings(spark, sf, "year", YEAR_REF)
    return presence.presence_days(held, X.employees(spark, sf)).select("id", "days_present")


@query
def presence_long(spark: SparkSession, sf: str) -> DataFrame:
    bounds = resolve_period("month", MONTH_REF)
    return presence.presence_long(X.bookings(spark, sf, *bounds), X.employees(spark, sf), *bounds)


@query
def attainment_week(spark: SparkSession, sf: str) -> DataFrame:
    return presence.attainment(
        _period_bookings(spark, sf, "week", WEEK_REF), X.employees(spark, sf), REPORT, "week", WEEK_REF
    )


@query
def attainment_month(spark: SparkSession, sf: str) -> DataFrame:
    return presence.attainment(
        _period_bookings(spark, sf, "month", MONTH_REF), X.employees(spark, sf), REPORT, "month", MONTH_REF
    )


@query
def attainment_long_month(spark: SparkSession, sf: str) -> DataFrame:
    return presence.attainment(
        _period_bookings(spark, sf, "month", LONG_MONTH_REF), X.employees(spark, sf), REPORT, "month", LONG_MONTH_REF
    )


@query
def presence_matrix_week(spark: SparkSession, sf: str) -> DataFrame:
    return presence.presence_matrix(
        _period_bookings(spark, sf, "week", WEEK_REF), X.employees(spark, sf), REPORT, "week", WEEK_REF
    )


@query
def presence_matrix_month(spark: SparkSession, sf: str) -> DataFrame:
    return presence.presence_matrix(
        _period_bookings(spark, sf, "month", MONTH_REF), X.employees(spark, sf), REPORT, "month", MONTH_REF
    )


# ---- commands and replay ----------------------------------------------------------------------------------------


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return replay(validation.valid_commands(X.commands(spark, sf)))


@query
def command_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate_commands(X.commands_raw(spark, sf)).select("seq", "op", "error")


@query
def command_authority(spark: SparkSession, sf: str) -> DataFrame:
    log = X.employee_cmds(spark, sf).withColumn("is_admin", F.col("seq") % 4 != 0)
    return log.select("seq", "id", "op", validation.authority_error(validation.ADMIN_EMPLOYEE_OPS).alias("error"))


@query
def booking_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(spark, sf).select("seq", "date", "shift", "kind", "slot", "outcome", "by")


def _cut(log: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """A log in two, at half of its largest number. It is written first, so that both halves are read and not made again."""
    log = checkpoint(log)
    cut = log.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    return log.where(F.col("seq") <= cut), log.where(F.col("seq") > cut), cut


@query
def booking_outcomes_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The log in two halves, the second going on from what the first left."""
    first, second, _ = _cut(validation.valid_commands(X.commands(spark, sf)))
    before = checkpoint(replay(first))
    after = replay(second, held=changes.settled_bookings(before))
    return before.unionByName(after).select("seq", "date", "shift", "kind", "slot", "outcome", "by")


@query
def booking_outcomes_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The same outcomes with every room of more than 150 commands replayed in chunks."""
    outcomes = replay(validation.valid_commands(X.commands(spark, sf)), chunk_rows=150)
    return outcomes.select("seq", "date", "shift", "kind", "slot", "outcome", "by")


@query
def bookings_settled_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(validation.valid_commands(X.commands(spark, sf)))
    held = checkpoint(changes.settled_bookings(replay(first)))
    return changes.settled_bookings(replay(second, held=held), held=held)


@query
def config_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(X.config_cmds(spark, sf))
    return settings.effective_settings(second, stored=settings.effective_settings(first))


def _from_logs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Settings]:
    """What the logs leave: settled bookings, employees and settings."""
    held = changes.settled_bookings(_outcomes(spark, sf))
    people = employees.current_employees(X.employee_cmds(spark, sf), X.config_cmds(spark, sf))
    return held, people, settings.settings_of(settings.effective_settings(X.config_cmds(spark, sf)))


@query
def report_from_logs_month(spark: SparkSession, sf: str) -> DataFrame:
    return U.summary(*_from_logs(spark, sf), "month", LOG_MONTH_REF)


@query
def attainment_from_logs_quarter(spark: SparkSession, sf: str) -> DataFrame:
    return presence.attainment(*_from_logs(spark, sf), "quarter", LOG_MONTH_REF)


@query
def bookings_settled(spark: SparkSession, sf: str) -> DataFrame:
    return changes.settled_bookings(_outcomes(spark, sf))


@query
def occupancy_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return changes.occupancy_intervals(_outcomes(spark, sf))


@query
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.change_feed(
        _outcomes(spark, sf), X.config_cmds(spark, sf), X.employee_cmds(spark, sf), X.feedback_cmds(spark, sf)
    )


@query
def booking_event_images(spark: SparkSession, sf: str) -> DataFrame:
    return images.event_images(_outcomes(spark, sf))


@query
def occupancy_intervals_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """What ended in the first half of the log, and all intervals of the second half, which goes on from what the first left."""
    first, second, _ = _cut(validation.valid_commands(X.commands(spark, sf)))
    before = checkpoint(replay(first))
    held = checkpoint(changes.settled_bookings(before))
    ended = changes.occupancy_intervals(before).where("valid_to is not null")
    return ended.unionByName(changes.occupancy_intervals(replay(second, held=held), held=held))


@query
def change_feed_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The events of the first halves of all four logs, and those of the second halves, which go on from the office left."""
    logs = (validation.valid_commands(X.commands(spark, sf)), X.config_cmds(spark, sf), X.employee_cmds(spark, sf), X.feedback_cmds(spark, sf))
    halves = [_cut(log) for log in logs]
    first, second = (changefeed.Logs(*(half[k] for half in halves)) for k in (0, 1))
    outcomes = checkpoint(changefeed.outcomes_of(first))
    left = changefeed.office_after(first, outcomes)
    office = changefeed.Office(**{name: checkpoint(table) for name, table in left.tables().items()})
    rest = (second.settings, second.employees, second.feedback)
    before = changefeed.change_feed(outcomes, first.settings, first.employees, first.feedback)
    return before.unionByName(changefeed.change_feed(changefeed.outcomes_of(second, office), *rest, before=office))


@query
def client_state(spark: SparkSession, sf: str) -> DataFrame:
    return spots.client_state(spots.spot_updates(X.commands(spark, sf)))


@query
def slot_status(spark: SparkSession, sf: str) -> DataFrame:
    return spots.slot_status(spots.client_state(spots.spot_updates(X.commands(spark, sf))), VIEWER)


# ---- folds of the other logs ------------------------------------------------------------------------------------


@query
def config_effective(spark: SparkSession, sf: str) -> DataFrame:
    return settings.effective_settings(X.config_cmds(spark, sf))


@query
def config_lists(spark: SparkSession, sf: str) -> DataFrame:
    numbers = F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",")
    return settings.effective_lists(X.config_cmds(spark, sf)).select("key", numbers.alias("numbers"))


@query
def config_lists_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(X.config_cmds(spark, sf))
    numbers = F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",")
    return settings.effective_lists(second, settings.effective_lists(first)).select("key", numbers.alias("numbers"))


@query
def shifts_normalized(spark: SparkSession, sf: str) -> DataFrame:
    log = X.employee_cmds(spark, sf).where(F.col("shifts").isNotNull())
    return log.select("seq", "id", F.array_join(shift_list(F.col("shifts")), ",").alias("shifts"))


@query
def employee_adds(spark: SparkSession, sf: str) -> DataFrame:
    return employees.requested_names(X.add_requests(spark, sf)).select("seq", "name")


@query
def employee_target_asof(spark: SparkSession, sf: str) -> DataFrame:
    adds = X.employee_cmds(spark, sf).where(F.col("op") == "add").select("seq", "id")
    return settings.target_as_of(adds, X.config_cmds(spark, sf))


@query
def employees_current(spark: SparkSession, sf: str) -> DataFrame:
    current = employees.current_employees(X.employee_cmds(spark, sf), X.config_cmds(spark, sf))
    return current.withColumn("shifts", F.array_join("shifts", ","))


@query
def employees_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(X.employee_cmds(spark, sf))
    people = checkpoint(employees.current_employees(first, X.config_cmds(spark, sf)))
    current = employees.current_employees(second, X.config_cmds(spark, sf), people=people)
    return current.withColumn("shifts", F.array_join("shifts", ","))


@query
def feedback_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(X.feedback_cmds(spark, sf))
    held = checkpoint(feedback.current_feedback(first))
    return feedback.current_feedback(second, held)


@query
def feedback_count_resumed(spark: SparkSession, sf: str) -> DataFrame:
    first, second, _ = _cut(X.feedback_cmds(spark, sf))
    held = checkpoint(feedback.current_feedback(first))
    return feedback.feedback_counts(first).unionByName(feedback.feedback_counts(second, held))


@query
def employee_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return employees.employee_rejects(X.employee_cmds(spark, sf))


@query
def feedback_clean(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.clean_submissions(X.feedback_cmds(spark, sf))


@query
def feedback_current(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.current_feedback(X.feedback_cmds(spark, sf))


@query
def feedback_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.feedback_rejects(X.feedback_cmds(spark, sf))


@query
def feedback_count_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.feedback_counts(X.feedback_cmds(spark, sf))


# ---- from JSON requests ------------------------------------------------------------------------------------------


@query
def request_bookings(spark: SparkSession, sf: str) -> DataFrame:
    commands = validation.validate_commands(R.booking_commands(X.requests(spark, sf)))
    return commands.select("seq", F.col("date").cast("string").alias("date"), "shift", "kind", "slot", "user_id", "error")


@query
def request_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting sent, as it is read: a number, or a list as text."""
    sent = R.settings_commands(X.requests(spark, sf))
    is_list = F.col("key").isin(*LIST_SETTINGS)
    value = F.when(is_list, F.col("raw_value")).otherwise(to_int(F.col("raw_value")).cast("string"))
    return sent.select("seq", "key", value.alias("value"))


@query
def request_employees(spark: SparkSession, sf: str) -> DataFrame:
    log = checkpoint(R.employee_commands(X.requests(spark, sf)))  # gone through several times
    current = employees.current_employees(log)
    return current.withColumn("shifts", F.array_join("shifts", ","))


@query
def request_feedback(spark: SparkSession, sf: str) -> DataFrame:
    log = checkpoint(R.feedback_commands(X.requests(spark, sf)))  # gone through several times
    return feedback.current_feedback(log).select("seq", "fb_id", "name", "message", "category", "read")


@query
def change_feed_requests(spark: SparkSession, sf: str) -> DataFrame:
    logs = follow.split_requests(X.requests(spark, sf))
    return changefeed.change_feed(changefeed.outcomes_of(logs), logs.settings, logs.employees, logs.feedback)


# ---- streaming twins --------------------------------------------------------------------------------------------


@query
def booking_outcomes_stream(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = live.outcomes_of_log(validation.valid_commands(X.commands(spark, sf)))
    return outcomes.select("seq", "date", "shift", "kind", "slot", "outcome", "by")


@query
def util_shift_live(spark: SparkSession, sf: str) -> DataFrame:
    return live.occupancy_of_log(validation.valid_commands(X.commands(spark, sf)))


@query
def booking_outcomes_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream in three batches, each replayed from the bookings stored by the one before."""
    path = follow.replayed_log(validation.valid_commands(X.commands(spark, sf)), follow.follow_bookings, 3)
    return follow.published(spark, path, "outcomes").select("seq", "date", "shift", "kind", "slot", "outcome", "by")


@query
def change_feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed of requests of all four kinds as a stream in two batches."""
    path = follow.replayed_log(X.requests(spark, sf), follow.follow_requests)
    return follow.published(spark, path, "events").drop("batch")
