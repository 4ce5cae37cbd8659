"""Every operator under its public name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from starmart.config import Config
from starmart.operators import (
    cumulative,
    explore,
    magnitude,
    quality,
    ranking,
    segment,
    share,
    trend,
)
from starmart.plans.customer_behavior import customer_behavior
from starmart.plans.product_performance import product_performance
from starmart.schema import Star

Operator = Callable[[Star, Config], DataFrame]

OPERATORS: dict[str, Operator] = {
    "dq_table_catalog": quality.table_catalog,
    "dq_column_profile": quality.column_profile,
    "dq_required": quality.required_values,
    "dq_unique_key": quality.repeated_keys,
    "dq_referential": quality.unknown_references,
    "explore_countries": explore.countries,
    "explore_catalog": explore.catalog_paths,
    "range_product_start": explore.product_start_range,
    "range_orders": explore.order_range,
    "range_customer_age": explore.customer_age_range,
    "measure_total_sales": explore.total_sales,
    "measure_total_quantity": explore.total_quantity,
    "measure_avg_price": explore.average_price,
    "measure_order_lines": explore.order_lines,
    "measure_unique_orders": explore.unique_orders,
    "measure_total_products": explore.total_products,
    "measure_total_customers": explore.total_customers,
    "measure_active_customers": explore.active_customers,
    "kpi_report": explore.kpi_report,
    "mag_customers_by_country": magnitude.customers_by_country,
    "mag_customers_by_gender": magnitude.customers_by_gender,
    "mag_products_by_subcategory": magnitude.products_by_subcategory,
    "mag_orders_by_country": magnitude.orders_by_country,
    "mag_revenue_by_country": magnitude.revenue_by_country,
    "mag_revenue_by_product": magnitude.revenue_by_product,
    "mag_times_sold": magnitude.times_sold,
    "mag_never_sold": magnitude.never_sold,
    "mag_sold_status": magnitude.sold_status,
    "mag_avg_cost_by_category": magnitude.average_cost_by_category,
    "mag_revenue_by_category": magnitude.revenue_by_category,
    "mag_revenue_by_customer": magnitude.revenue_by_customer,
    "mag_items_by_country": magnitude.items_by_country,
    "rank_customers_in_year": ranking.customers_in_year,
    "dense_rank_customers_in_year": ranking.customers_in_year_dense,
    "rank_products_per_year": ranking.products_per_year,
    "dense_rank_products_per_year": ranking.products_per_year_dense,
    "rank_products_profit": ranking.products_by_profit,
    "rank_products_in_quarter": ranking.products_in_quarter,
    "rank_categories": ranking.categories,
    "rank_subcategories": ranking.subcategories,
    "top5_products": ranking.top_products,
    "top5_products_ranked": ranking.top_products_ranked,
    "bottom5_products": ranking.bottom_products,
    "top10_customers": ranking.top_customers,
    "bottom3_customers_orders": ranking.customers_with_fewest_orders,
    "time_seasonal_mix": trend.seasonal_mix,
    "time_period_products": trend.period_products,
    "time_monthly_sales": trend.monthly_sales,
    "time_best_month": trend.best_month,
    "time_worst_month": trend.worst_month,
    "time_annual_scorecard": trend.annual_scorecard,
    "time_calendar_month": trend.calendar_month,
    "time_year_month": trend.year_month,
    "time_month_start": trend.month_start,
    "time_month_label": trend.month_label,
    "cum_annual": cumulative.annual,
    "cum_ytd": cumulative.year_to_date,
    "cum_monthly": cumulative.monthly,
    "cum_customer_spend": cumulative.customer_spend,
    "cum_product_units": cumulative.product_units,
    "share_sales_by_category": share.sales_by_category,
    "share_orders_by_category": share.orders_by_category,
    "share_customer_penetration": share.customer_penetration,
    "segment_cost_range": segment.cost_ranges,
    "segment_customers": segment.customer_segments,
    "product_performance": product_performance,
    "customer_behavior": customer_behavior,
}
