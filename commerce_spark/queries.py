"""The registry of named queries: name -> (DataFrame plan, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commerce_spark.plans import atoms, documents, kpi, oracle, portfolio
from commerce_spark.plans.views import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {
    "k01_executive": kpi.executive, "k02_concentration": kpi.concentration, "k03_management_signals": kpi.management_signals, "k04_life_cycle": kpi.life_cycle, "k05_inactive": kpi.inactive, "k06_abc": kpi.abc,
    "k07_sellers": kpi.sellers, "k08_forecast_accuracy": kpi.forecast_accuracy, "k09_shrinking": kpi.shrinking, "k10_margin_erosion": kpi.margin_erosion, "k11_intelligence": kpi.intelligence, "k12_totals": kpi.totals,
    "k13_calendar": kpi.calendar, "k14_entries": kpi.entries, "k15_revenue_and_targets": kpi.revenue_and_targets, "k16_performance": kpi.performance, "k17_performance_percent": kpi.performance_percent, "k18_base_counts": kpi.base_counts, "k20_base_totals": kpi.base_totals,
    "k21_orders": portfolio.orders, "k22_order_facts": portfolio.order_facts, "k23_item_facts": portfolio.item_facts, "k24_monthly": portfolio.monthly, "k25_seller_months": portfolio.seller_months, "k26_behaviour": portfolio.behaviour, "k27_cohorts": portfolio.cohorts,
    "k28_revenue_concentration": portfolio.revenue_concentration, "k29_customer_versions": portfolio.customer_versions, "k29_months": portfolio.month_dimension, "k29_products": portfolio.product_dimension, "k29_sellers": portfolio.seller_dimension,
    "k30_staged_orders": portfolio.staged_orders, "k30_staged_items": portfolio.staged_items, "k30_staged_customers": portfolio.staged_customers, "k30_staged_products": portfolio.product_dimension, "k30_staged_sellers": portfolio.seller_dimension, "k31_covers_customers": portfolio.covers_customers, "k32_no_duplicates": portfolio.no_duplicates, "k33_dates_inside": portfolio.dates_inside, "k34_revenue_reconciles": portfolio.revenue_reconciles,
    "k35_behaviour_in_range": portfolio.behaviour_in_range, "k36_items_valid": portfolio.items_valid, "k37_items_reconcile": portfolio.items_reconcile, "k38_orders_in_validity": portfolio.orders_in_validity, "k39_orders_without_items": portfolio.orders_without_items,
    "k40_one_current_version": portfolio.one_current_version, "k41_versions_apart": portfolio.versions_apart, "k42_versions_valid": portfolio.versions_valid, "k43_category_mix": portfolio.category_mix, "k44_contacts": portfolio.contacts, "k45_signal_summary": portfolio.signal_summary,
    "k46_retention": portfolio.retention, "k47_moved_portfolio": portfolio.moved_portfolio, "k48_portfolio_inspection": portfolio.portfolio_inspection,
    "k48_inspect_versions": portfolio.inspect_versions, "k48_inspect_orders": portfolio.inspect_orders, "k48_inspect_sellers": portfolio.inspect_sellers,
}


def _query(plan: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(plan) for name, plan in (PLANS | atoms.PLANS | documents.PLANS).items()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | atoms.SQL | documents.SQL
