"""One row per lead: outcome labels, label maturity, and features known when the lead arrives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import day_gap, weekday_from_monday, weekday_from_sunday
from ..operators.point_in_time import prior_and_full_counts

NO_CHANNEL = "not_recorded"


def won_within(lag: Column, horizon: int) -> Column:
    """Never NULL: a lead without a win, or with one before contact, is simply not won."""
    return F.coalesce(lag.between(0, horizon), F.lit(False))


def lead_features(leads: DataFrame, deals: DataFrame, horizon: int = 90, scope_from: str = "2018-01-01") -> DataFrame:
    """Deals are unique per lead. Only the date, page and channel of a lead are features; nothing that
    is recorded when a deal closes is."""
    counted = prior_and_full_counts(leads, "landing_page_id", "first_contact_date",
                                    "page_lead_volume_prior", "page_lead_volume")
    wins = deals.select("mql_id", F.to_date("won_at").alias("won_date"), F.lit(True).alias("_won"))
    contact = F.col("first_contact_date")
    lag = day_gap(contact, "won_date")
    first_contact = leads.agg(F.min("first_contact_date")).scalar()
    weekday = weekday_from_sunday(contact)
    return counted.join(wins, "mql_id", "left").select(
        "mql_id",
        won_within(lag, horizon).alias("is_won"),
        F.col("_won").isNotNull().alias("is_won_ever"),
        lag.alias("days_to_win"),
        "won_date",
        F.date_add(contact, horizon + 1).alias("label_mature_on"),
        (contact >= F.lit(scope_from).cast("date")).alias("is_in_model_window"),
        contact.alias("first_contact_date"),
        F.coalesce("lead_origin_channel", F.lit(NO_CHANNEL)).alias("lead_origin_channel"),
        "landing_page_id", "page_lead_volume", "page_lead_volume_prior",
        F.month(contact).alias("contact_month"),
        F.year(contact).alias("contact_year"),
        weekday.alias("contact_dow"),
        weekday.isin(0, 6).alias("is_weekend_contact"),
        day_gap(first_contact, contact).alias("days_since_campaign_start"),
    )


def label_as_of(df: DataFrame, as_of: str, horizon: int, name: str = "label") -> DataFrame:
    """Won within the horizon and the win dated strictly before ``as_of``."""
    lag = day_gap("first_contact_date", "won_date")
    known = F.coalesce(F.col("won_date") < F.lit(as_of).cast("date"), F.lit(False))
    return df.withColumn(name, (won_within(lag, horizon) & known).cast("int"))


def immature_labels(df: DataFrame, as_of: str, horizon: int) -> DataFrame:
    mature_on = F.date_add("first_contact_date", horizon + 1)
    return df.agg(F.count("*").alias("leads"),
                  F.count_if(mature_on > F.lit(as_of).cast("date")).alias("immature"))


def audit_split(df: DataFrame, train_from: str, train_to: str, cut: str, horizon: int) -> DataFrame:
    """What a training cohort's labels looked like at a cut: when outcome windows end, when labels
    become usable, and the share usable at the cut (NULL for an empty cohort)."""
    cohort = df.where(F.col("first_contact_date").between(F.lit(train_from).cast("date"), F.lit(train_to).cast("date")))
    ends = F.date_add("first_contact_date", horizon)
    usable = F.date_add("first_contact_date", horizon + 1)
    return cohort.agg(
        F.count("*").alias("train_leads"),
        F.min(ends).alias("first_window_end"), F.max(ends).alias("last_window_end"),
        F.min(usable).alias("first_usable_on"), F.max(usable).alias("last_usable_on"),
        F.avg((usable <= F.lit(cut).cast("date")).cast("double")).alias("share_usable_at_cut"),
    ).withColumn("latest_contact_usable", F.date_sub(F.lit(cut).cast("date"), horizon + 1))


FEATURE_COUNTS = {"point_in_time": "page_lead_volume_prior", "legacy_full_dataset": "page_lead_volume"}
NUMERIC_FEATURES = ("log_page_volume", "contact_weekday", "is_weekend")


def design_matrix(df: DataFrame, feature_set: str = "point_in_time") -> DataFrame:
    """Adds the model inputs. Weekdays count from Monday here, unlike ``contact_dow``."""
    weekday = weekday_from_monday("first_contact_date").cast("double")
    return (
        df.withColumn("channel", F.coalesce("lead_origin_channel", F.lit(NO_CHANNEL)))
        .withColumn("log_page_volume", F.log1p(F.col(FEATURE_COUNTS[feature_set]).cast("double")))
        .withColumn("contact_weekday", weekday)
        .withColumn("is_weekend", (weekday >= 5).cast("double"))
    )
