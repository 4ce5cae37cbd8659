"""DuckDB statements that state every registered query a second time.

They run on the raw test tables. The first block rebuilds the star (see
``sources.tpch``); each statement below it is written against the star.
"""

from __future__ import annotations

# Stated here a second time, so that the checked code is not compared with itself.
_COLUMNS = {
    "dim_customers": "customer_key bigint, customer_id bigint, customer_number string,"
    " first_name string, last_name string, country string, marital_status string,"
    " gender string, birthdate date, create_date date",
    "dim_products": "product_key bigint, product_id bigint, product_number string,"
    " product_name string, category_id string, category string, subcategory string,"
    " maintenance string, cost int, product_line string, start_date date",
    "fact_sales": "order_number string, product_key bigint, customer_key bigint,"
    " order_date date, shipping_date date, due_date date, sales_amount int,"
    " quantity smallint, price int",
}
TABLES = {
    table: [tuple(column.split()) for column in columns.split(", ")]
    for table, columns in _COLUMNS.items()
}
REQUIRED = {
    "dim_customers": ["customer_key", "customer_id"],
    "dim_products": ["product_key", "product_id"],
    "fact_sales": ["order_number", "product_key", "customer_key"],
}

_STAR = """
dated_lines as (
    select l.*, o.*,
        case
            when o_orderkey % 200 = 19 then null
            when o_custkey % 100 = 60 then date '2000-09-01' + age % 30
            when o_custkey % 20 = 0 then date '2000-10-01' + age % 300
            when o_custkey % 20 = 10 then date '2000-02-01' + age % 330
            when o_custkey % 10 = 1 and placed >= date '1999-12-01' then placed - 730
            when o_custkey % 10 = 2 and placed >= date '2000-09-01' then placed - 365
            else placed
        end as order_date,
        case
            when o_custkey % 100 = 40 then 10000.0
            when o_custkey % 10 = 3 or o_custkey % 100 = 20 then 1000.0
            when l_partkey % 25 = 16 then 10.0
            else 100.0
        end::double as divisor
    from lineitem l
    left join (
        select *, o_orderdate::date as placed,
            cast(o_orderdate::date - date '1995-01-01' as integer) as age
        from orders
    ) o on l.l_orderkey = o.o_orderkey
),
fact_sales as (
    select
        'SO' || o_orderkey as order_number,
        case
            when o_orderkey % 400 = 29 then null
            when l_partkey % 50 = 11 then -l_partkey
            when l_partkey % 25 = 4
                or (l_partkey % 25 = 6 and order_date >= date '1999-01-01')
                or (l_partkey % 25 = 8 and order_date >= date '2000-04-01')
                or (l_partkey % 25 = 14 and order_date >= date '2000-09-10') then l_partkey + 1
            when l_partkey % 25 = 20 and order_date < date '2000-06-01' then l_partkey - 1
            else l_partkey
        end as product_key,
        case
            when o_orderkey % 400 = 23 then null
            when o_custkey % 50 = 7 then -o_custkey
            else o_custkey
        end as customer_key,
        order_date,
        l_shipdate::date as shipping_date,
        placed as due_date,
        floor(l_extendedprice / divisor)::integer as sales_amount,
        l_quantity::smallint as quantity,
        floor(l_extendedprice / divisor / l_quantity)::integer as price
    from dated_lines
),
dim_customers as (
    select
        c_custkey as customer_key,
        c_custkey + 10000 as customer_id,
        c_name as customer_number,
        case when c_custkey % 17 <> 0 then c_mktsegment end as first_name,
        c_name as last_name,
        n_name as country,
        case when c_custkey % 2 = 0 then 'Married' else 'Single' end as marital_status,
        case when c_custkey % 5 = 0 then null when c_custkey % 5 < 3 then 'Male'
            else 'Female' end as gender,
        case when c_custkey % 13 <> 0
            then date '1940-01-01' + cast(c_custkey * 37 % 20000 as integer) end as birthdate,
        date '1995-01-01' as create_date
    from customer left join nation on c_nationkey = n_nationkey
),
dim_products as (
    select
        p_partkey as product_key,
        p_partkey + 200 as product_id,
        'PN-' || p_partkey as product_number,
        p_name || ' ' || (p_partkey % 100) as product_name,
        upper(substr(p_type, 1, 2)) as category_id,
        case when p_partkey % 40 <> 3 then p_type end as category,
        case when p_partkey % 40 <> 3 then p_brand end as subcategory,
        case when p_partkey % 2 = 0 then 'Yes' else 'No' end as maintenance,
        case when p_partkey % 97 = 5 then null when p_partkey % 9 = 0 then p_size * 40
            when p_partkey % 5 = 0 then p_size * 8 else p_size end as cost,
        case p_partkey % 4 when 0 then 'Road' when 1 then 'Mountain'
            else 'Other Sales' end as product_line,
        date '1993-07-01' + cast(p_partkey % 4 * 365 as integer) as start_date
    from part
)
"""


def _star(body: str, steps: str = "") -> str:
    return f"with {_STAR}{', ' + steps if steps else ''} {body}"


def _columns(table: str) -> str:
    return ", ".join(name for name, _ in TABLES[table])


def _rounded(part: str, whole: str, digits: int) -> str:
    """Quotient of two whole numbers, rounded half away from zero.

    Whole-number arithmetic: rounding the binary quotient itself gives 132.57 or
    132.58 for 5303 / 40, depending on the engine.
    """
    unit = 10**digits
    steps = f"(2 * abs({part})::hugeint * {unit} + {whole}) // (2 * {whole})"
    # Adding 0.0 turns a negative zero into zero.
    return f"(sign({part}) * ({steps})::double / {unit}.0 + 0.0)"


def _percent(part: str, whole: str) -> str:
    text = f"printf('%.2f', {_rounded(f'({part} * 100)', whole, 2)})"
    return f"regexp_replace({text}, '\\.?0+$', '') || '%'"


def _months(start: str, end: str) -> str:
    return f"cast(date_diff('month', {start}, {end}) as integer)"


def _years(start: str, end: str) -> str:
    return f"cast(date_diff('year', {start}, {end}) as integer)"


_ANCHOR = "date '2000-12-31'"


def _ingestion() -> dict[str, str]:
    return {
        "ingest_customers": _star(f"select {_columns('dim_customers')} from dim_customers"),
        "ingest_products": _star(f"select {_columns('dim_products')} from dim_products"),
        "ingest_sales": _star(f"select {_columns('fact_sales')} from fact_sales"),
    }


def _quality() -> dict[str, str]:
    catalog = " union all ".join(
        f"select 'spark_catalog' as table_catalog, 'default' as table_schema,"
        f" '{t}' as table_name, 'BASE TABLE' as table_type, count(*) as row_count from {t}"
        for t in TABLES
    )
    profile = []
    for table, columns in TABLES.items():
        for name, kind in columns:
            text = kind == "string"
            profile.append(
                f"select '{table}' as table_name, '{name}' as column_name,"
                f" '{kind}' as data_type, '{kind}' as declared_type, 'YES' as is_nullable,"
                f" {50 if text else 'null'}::integer as character_maximum_length,"
                f" count(*) - count({name}) as null_values,"
                f" {f'max(length({name}))' if text else 'null'}::integer as longest_value"
                f" from {table}"
            )
    required = " union all ".join(
        f"select '{table}' as table_name, '{column}' as column_name,"
        f" count(*) - count({column}) as violations from {table}"
        for table, columns in REQUIRED.items()
        for column in columns
    )
    return {
        "dq_table_catalog": _star(catalog),
        "dq_column_profile": _star(" union all ".join(profile)),
        "dq_required": _star(required),
        "dq_unique_key": _star("""
            select 'dim_customers' as table_name,
                '{"customer_key":' || customer_key || '}' as key_value,
                count(*) as copies
            from dim_customers group by customer_key having count(*) > 1
            union all
            select 'dim_products', '{"product_key":' || product_key || '}', count(*)
            from dim_products group by product_key having count(*) > 1
            union all
            select 'fact_sales',
                '{' || concat_ws(',', '"order_number":"' || order_number || '"',
                    '"product_key":' || product_key) || '}', count(*)
            from fact_sales group by order_number, product_key having count(*) > 1
        """),
        "dq_referential": _star("""
            select 'customer_key' as key_column, customer_key as key_value, count(*) as sales_rows
            from fact_sales
            where customer_key is not null
                and not exists (select 1 from dim_customers c
                                where c.customer_key = fact_sales.customer_key)
            group by customer_key
            union all
            select 'product_key', product_key, count(*)
            from fact_sales
            where product_key is not null
                and not exists (select 1 from dim_products p
                                where p.product_key = fact_sales.product_key)
            group by product_key
        """),
    }


def _exploration() -> dict[str, str]:
    one = {
        "explore_countries": "select distinct country from dim_customers",
        "explore_catalog": "select distinct category, subcategory, product_name from dim_products",
        "range_product_start": f"""
            select min(start_date) as first_product_start_date,
                max(start_date) as last_product_start_date,
                {_months('min(start_date)', 'max(start_date)')} as catalog_expansion_months
            from dim_products""",
        "range_orders": f"""
            select min(order_date) as first_order_date, max(order_date) as last_order_date,
                {_months('min(order_date)', 'max(order_date)')} as order_range_months
            from fact_sales""",
        "range_customer_age": f"""
            select min(birthdate) as oldest_birthdate,
                {_years('min(birthdate)', _ANCHOR)} as oldest_current_age,
                max(birthdate) as youngest_birthdate,
                {_years('max(birthdate)', _ANCHOR)} as youngest_current_age
            from dim_customers""",
        "measure_total_sales": "select sum(sales_amount)::bigint as total_sales from fact_sales",
        "measure_total_quantity": "select sum(quantity)::bigint as total_quantity from fact_sales",
        "measure_avg_price":
            "select cast(sum(price) // count(price) as integer) as avg_price from fact_sales",
        "measure_order_lines": "select count(order_number) as total_orders from fact_sales",
        "measure_unique_orders":
            "select count(distinct order_number) as total_unique_orders from fact_sales",
        "measure_total_products": "select count(product_id) as total_products from dim_products",
        "measure_total_customers":
            "select count(customer_id) as total_customers from dim_customers",
        "measure_active_customers":
            "select count(distinct customer_key) as total_active_customers from fact_sales",
        "kpi_report": """
            select 'Total Sales' as metric_name, sum(sales_amount)::bigint as metric_value
            from fact_sales
            union all select 'Total Quantity', sum(quantity)::bigint from fact_sales
            union all select 'Average Price', cast(sum(price) // count(price) as bigint)
            from fact_sales
            union all select 'Total Orders', count(distinct order_number) from fact_sales
            union all select 'Total Products', count(distinct product_name) from dim_products
            union all select 'Total Customers', count(customer_key) from dim_customers""",
    }
    return {name: _star(sql) for name, sql in one.items()}


def _magnitude() -> dict[str, str]:
    with_customer = "fact_sales f left join dim_customers c using (customer_key)"
    with_product = "fact_sales f left join dim_products p using (product_key)"
    unsold = """
        select product_name, category, subcategory, count(f.product_key) as times_sold
        from dim_products p left join fact_sales f on f.product_key = p.product_key
        group by all"""
    one = {
        "mag_customers_by_country": """
            select country, count(customer_id) as total_customers
            from dim_customers group by country""",
        "mag_customers_by_gender": """
            select gender, count(customer_id) as total_customers
            from dim_customers group by gender""",
        "mag_products_by_subcategory": """
            select category, subcategory, count(product_id) as unique_products_count
            from dim_products group by category, subcategory""",
        "mag_orders_by_country": f"""
            select country, count(distinct order_number) as total_orders
            from {with_customer} group by country""",
        "mag_revenue_by_country": f"""
            select country, sum(sales_amount)::bigint as total_sales_amount
            from {with_customer} group by country""",
        "mag_revenue_by_product": f"""
            select product_line, category, subcategory, product_name,
                sum(sales_amount)::bigint as total_sales_amount
            from {with_product} group by all""",
        "mag_times_sold": """
            select product_name, category, subcategory, count(*) as times_sold
            from fact_sales join dim_products using (product_key) group by all""",
        "mag_never_sold": f"""
            select product_name, category, subcategory from ({unsold}) where times_sold = 0""",
        "mag_sold_status": f"""
            select *, if(times_sold = 0, 'Unsold', 'Sold') as product_status from ({unsold})""",
        "mag_avg_cost_by_category": """
            select category, cast(sum(cost) // count(cost) as integer) as avg_cost
            from dim_products group by category""",
        "mag_revenue_by_category": f"""
            select category, sum(sales_amount)::bigint as total_revenue
            from {with_product} group by category""",
        "mag_revenue_by_customer": """
            select c.customer_key, first_name, last_name,
                sum(sales_amount)::bigint as total_revenue
            from fact_sales f left join dim_customers c on c.customer_key = f.customer_key
            group by all""",
        "mag_items_by_country": f"""
            select country, sum(quantity)::bigint as total_sold_items
            from {with_customer} group by country""",
    }
    return {name: _star(sql) for name, sql in one.items()}


def _ranking() -> dict[str, str]:
    year_customers = """
        yearly as (
            select cast(year(order_date) as integer) as sales_year, c.customer_key, first_name,
                last_name, sum(sales_amount)::bigint as total_revenue
            from fact_sales f join dim_customers c on c.customer_key = f.customer_key
            group by all
        )"""
    year_products = """
        yearly as (
            select cast(year(order_date) as integer) as sales_year, p.product_key, product_name,
                cast(sum(sales_amount) - sum(cost * quantity) as bigint) as total_profit
            from fact_sales f join dim_products p on p.product_key = f.product_key
            group by all
        )"""
    names = """
        named as (
            select product_name, sum(sales_amount)::bigint as total_revenue
            from fact_sales left join dim_products using (product_key) group by product_name
        )"""

    def leading(steps: str, function: str, value: str, name: str, last: int, extra="true") -> str:
        return _star(
            f"""select *, {function}() over (
                    partition by sales_year order by {value} desc nulls last) as {name}
                from yearly where {extra} qualify {name} <= {last}""",
            steps,
        )

    def groups(attribute: str, name: str) -> str:
        return _star(
            f"""select {attribute}, total_revenue,
                    rank() over (order by total_revenue desc nulls last) as {name}
                from (select {attribute}, sum(sales_amount)::bigint as total_revenue
                      from fact_sales join dim_products using (product_key)
                      group by {attribute})"""
        )

    return {
        "rank_customers_in_year": leading(
            year_customers, "rank", "total_revenue", "rank_customers", 10, "sales_year = 2001"
        ),
        "dense_rank_customers_in_year": leading(
            year_customers, "dense_rank", "total_revenue", "dense_rank_customers", 10,
            "sales_year = 2001",
        ),
        "rank_products_per_year": leading(
            year_products, "rank", "total_profit", "rank_products", 5
        ),
        "dense_rank_products_per_year": leading(
            year_products, "dense_rank", "total_profit", "dense_rank_products", 5
        ),
        "rank_products_profit": _star("""
            select product_name, profit, rank() over (order by profit desc nulls last)
                as rank_profit
            from (select product_name,
                      cast(sum(sales_amount) - sum(cost * quantity) as bigint) as profit
                  from fact_sales join dim_products using (product_key) group by product_name)"""),
        "rank_products_in_quarter": _star("""
            select *, rank() over (partition by quarter order by total_revenue desc nulls last)
                as rank_in_quarter
            from (select cast(quarter(order_date) as integer) as quarter, product_name,
                      sum(sales_amount)::bigint as total_revenue
                  from fact_sales join dim_products using (product_key) group by all)"""),
        "rank_categories": groups("category", "rank_category"),
        "rank_subcategories": groups("subcategory", "rank_subcategory"),
        "top5_products": _star(
            "select * from named order by total_revenue desc nulls last,"
            " product_name nulls first limit 5",
            names,
        ),
        "top5_products_ranked": _star(
            "select *, rank() over (order by total_revenue desc nulls last) as rank_products"
            " from named qualify rank_products <= 5",
            names,
        ),
        "bottom5_products": _star(
            "select * from named order by total_revenue nulls first,"
            " product_name nulls first limit 5",
            names,
        ),
        "top10_customers": _star("""
            select c.customer_key, first_name, last_name,
                sum(sales_amount)::bigint as total_revenue
            from fact_sales f left join dim_customers c on c.customer_key = f.customer_key
            group by all
            order by total_revenue desc nulls last, 1 nulls first limit 10"""),
        "bottom3_customers_orders": _star("""
            select c.customer_key, first_name, last_name,
                count(distinct order_number) as total_orders
            from fact_sales f left join dim_customers c on c.customer_key = f.customer_key
            group by all
            order by total_orders nulls first, 1 nulls first limit 3"""),
    }


def _trend() -> dict[str, str]:
    measures = """sum(sales_amount)::bigint as total_sales,
        count(distinct customer_key) as total_customers,
        sum(quantity)::bigint as total_quantity"""
    year = "cast(year(order_date) as integer) as order_year"
    month = "cast(month(order_date) as integer) as order_month"
    mean_cost = "cast(sum(cost) // count(cost) as integer) as average_cost"
    one = {
        "time_seasonal_mix": f"""
            select {month}, {mean_cost}, count(distinct f.product_key) as total_products,
                count(*) as total_transactions
            from fact_sales f left join dim_products p on p.product_key = f.product_key
            where order_date is not null group by 1""",
        "time_period_products": f"""
            select {month}, {year}, p.product_key, product_name, {mean_cost},
                count(*) as total_transactions
            from fact_sales f left join dim_products p on p.product_key = f.product_key
            where year(order_date) = 2000 and month(order_date) = 12
            group by 1, 2, 3, 4""",
        "time_monthly_sales": f"""
            select {year}, {month}, sum(sales_amount)::bigint as total_sales
            from fact_sales where order_date is not null group by 1, 2""",
        "time_best_month": """
            select cast(month(order_date) as integer) as best_month,
                sum(sales_amount)::bigint as max_sales
            from fact_sales group by 1 order by 2 desc nulls last, 1 nulls first limit 1""",
        "time_worst_month": """
            select cast(month(order_date) as integer) as worst_month,
                sum(sales_amount)::bigint as min_sales
            from fact_sales group by 1 order by 2 nulls first, 1 nulls first limit 1""",
        "time_annual_scorecard": f"""
            select {year}, {measures}, count(distinct product_key) as total_products
            from fact_sales where order_date is not null group by 1""",
        "time_calendar_month": f"""
            select {month}, {measures}
            from fact_sales where order_date is not null group by 1""",
        "time_year_month": f"""
            select {year}, {month}, {measures}
            from fact_sales where order_date is not null group by 1, 2""",
        "time_month_start": f"""
            select date_trunc('month', f.order_date)::date as order_date, {measures}
            from fact_sales f where f.order_date is not null group by 1""",
        "time_month_label": f"""
            select strftime(order_date, '%Y-%b') as order_date_label, {measures}
            from fact_sales where order_date is not null group by 1""",
    }
    return {name: _star(sql) for name, sql in one.items()}


def _cumulative() -> dict[str, str]:
    def periods(unit: str, name: str) -> str:
        return f"""
            periods as (
                select date_trunc('{unit}', order_date)::date as {name},
                    sum(sales_amount)::bigint as total_sales,
                    cast(sum(price) // count(price) as integer) as mean
                from fact_sales where order_date is not null group by 1
            )"""

    def running(name: str, window: str, total: str, mean: str) -> str:
        return f"""
            select {name}, total_sales, cast(sum(total_sales) over w as bigint) as {total},
                cast(sum(mean) over w // count(mean) over w as integer) as {mean}
            from periods window w as ({window} order by {name} nulls first)"""

    lifetime = ("running_total_sales", "rolling_average_price")
    return {
        "cum_annual": _star(
            running("order_year", "", *lifetime), periods("year", "order_year")
        ),
        "cum_ytd": _star(
            running(
                "order_month", "partition by year(order_month)",
                "ytd_running_sales", "ytd_rolling_avg_price",
            ),
            periods("month", "order_month"),
        ),
        "cum_monthly": _star(
            running("order_month", "", *lifetime), periods("month", "order_month")
        ),
        "cum_customer_spend": _star("""
            select customer_key, order_date, order_number,
                cast(sum(sales_amount) over (
                    partition by customer_key
                    order by order_date nulls first, order_number nulls first
                ) as bigint) as cumulative_spend
            from fact_sales where order_date is not null"""),
        "cum_product_units": _star("""
            select *, cast(sum(monthly_units_sold) over (
                    partition by product_key order by order_month nulls first
                ) as bigint) as cumulative_units_sold
            from (select product_key, date_trunc('month', order_date)::date as order_month,
                      sum(quantity)::bigint as monthly_units_sold
                  from fact_sales where order_date is not null group by 1, 2)"""),
    }


def _shares() -> dict[str, str]:
    return {
        "share_sales_by_category": _star(
            f"""select category, total_sales, total as overall_sales,
                    {_percent('total_sales', 'total')} as percentage_of_total
                from groups, (select sum(total_sales)::bigint as total from groups)""",
            """groups as (
                select category, sum(sales_amount)::bigint as total_sales
                from fact_sales join dim_products using (product_key)
                where category is not null group by category
            )""",
        ),
        "share_orders_by_category": _star(
            f"""select category, total_orders, total as true_overall_orders,
                    {_percent('total_orders', 'total')} as percentage_of_total
                from (select category, count(distinct order_number) as total_orders
                      from fact_sales join dim_products using (product_key)
                      where category is not null group by category),
                    (select count(distinct order_number) as total from fact_sales)"""
        ),
        "share_customer_penetration": _star(
            f"""select category, buyers as unique_category_customers,
                    total as total_distinct_store_customers,
                    {_percent('buyers', 'total')} as customer_penetration_rate
                from (select category, count(distinct customer_key) as buyers
                      from dim_products left join fact_sales using (product_key)
                      where category is not null group by category),
                    (select count(distinct customer_key) as total from fact_sales)"""
        ),
    }


def _segments() -> dict[str, str]:
    return {
        "segment_cost_range": _star("""
            select case when cost between 501 and 1000 then '500-1000'
                    when cost between 100 and 500 then '100-500'
                    when cost < 100 then 'Below 100'
                    else 'Above 1000' end as cost_range,
                count(product_key) as total_products
            from dim_products group by 1"""),
        "segment_customers": _star(
            """select case
                    when recent and age >= 12 and spend > 5000 then 'Core VIP (Established)'
                    when spend is null and (idle < 3 or idle = 3 and age > 3) then 'Regular'
                    when recent and age <= 3 then
                        case when spend > 5000 then 'New VIP (Shooting Star)'
                            when spend >= 1000 then 'New Account (Growth Driver)'
                            else 'Standard New (Low Spend)' end
                    when age <= 3 and idle = 3 then 'Cold New Lead'
                    when idle > 11 then 'Lost / Inactive'
                    when idle > 3 then 'At Risk / Slipping'
                    else 'Regular' end as detailed_customer_segment,
                count(customer_key) as total_customers
            from accounts group by 1""",
            f"""accounts as (
                select c.customer_key, sum(sales_amount) as spend,
                    {_months('min(order_date)', _ANCHOR)} as age,
                    {_months('max(order_date)', _ANCHOR)} as idle,
                    idle <= 2 as recent
                from fact_sales f left join dim_customers c on c.customer_key = f.customer_key
                where order_date is not null group by c.customer_key
            )""",
        ),
    }


def _yearly(year: int) -> str:
    return f"coalesce(sum(sales_amount) filter (year(order_date) = {year}), 0)::bigint"


_GROWTH = f"""
    case when before = 0 then if(after > 0, 1.0, 0.0)::double
        when before > 0 and after = 0 then -1.0
        else {_rounded('(after - before)', 'before', 4)} end"""


def _reports() -> dict[str, str]:
    product = _star(
        f"""
        select product_key, product_name, category, subcategory, cost, last_sale_date,
            recency as recency_in_months,
            case when known and sales = 0 then 'Dead Stock (Zero Lifetime Sales)'
                when recency > 12 then 'Obsolete / Dead Stock (12+ Months Inactive)'
                when recency > 6 then 'At Risk / Approaching Obsolete'
                when recency > 2 then 'Slow-Moving (Watch List)'
                when recency is not null then 'Active / Fast-Moving'
                else 'Unmapped Sales Transaction' end as product_obsolescence_status,
            case when sales < 10000 then 'Low-Performer (Lifetime)'
                when sales <= 50000 then 'Mid-Range (Lifetime)'
                else 'High-Performer (Lifetime)' end as lifetime_sales_tier,
            case when sales = 0 then 'Unsold Catalog Item'
                when lifespan = 0 and orders > 1 then 'Single-Month Burst'
                when lifespan > 12 then 'Extended Run (12+ Months Active)'
                when lifespan > 6 then 'Standard Run (7-12 Months Active)'
                else 'Short Run (1-6 Months Active)' end as active_lifespan_tier,
            case when sales = 0 then 'No Sales Activity'
                when not known then 'Cost Data Missing (Unmapped Product)'
                when profit::double / sales <= 0 then 'Unprofitable Loss Leader (<0%)'
                when profit::double / sales < 0.15 then 'Low Margin / Volume Driver (0%-15%)'
                when profit::double / sales <= 0.40 then 'Stable Margin Core (15%-40%)'
                else 'High Margin Driver (40%+)' end as product_margin_segment,
            case when not known then 'Cost Data Missing (Unmapped Product)'
                when profit < 0 then 'Negative Cash Drain (<$0)'
                when profit < 5000 then 'Low Cash / Minor Contributor ($0-$5k)'
                when profit <= 20000 then 'Steady Cash Contributor ($5k-$20k)'
                else 'Massive Cash Generator (>$20k)' end as product_profit_volume_segment,
            case when orders > 5 then 'Repeat Purchase' when orders > 1 then 'Occasional Purchase'
                when orders = 1 then 'One-Time Sale'
                else 'No Purchases' end as purchase_frequency_tier,
            sales as total_sales, units as total_quantity, orders as total_orders,
            buyers as total_customers, lifespan as lifespan_months,
            {_rounded('sales', 'nullif(units, 0)', 1)} as avg_selling_price,
            coalesce({_rounded('sales', 'nullif(orders, 0)', 2)}, 0.0) as avg_order_revenue,
            {_rounded('sales', '(coalesce(lifespan, 0) + 1)', 2)} as avg_monthly_revenue,
            before as sales_1999, after as sales_2000,
            {_GROWTH} as product_yoy_sales_growth_rate
        from facts""",
        f"""summary as (
            select product_key as sold_key, min(order_date) as first_sale,
                max(order_date) as last_sale_date, count(distinct order_number) as orders,
                count(distinct customer_key) as buyers, sum(sales_amount)::bigint as sales,
                sum(quantity)::bigint as units,
                {_yearly(1999)} as before, {_yearly(2000)} as after
            from fact_sales where order_date is not null group by product_key
        ), facts as (
            select coalesce(product_key, sold_key) as product_key,
                coalesce(product_name, 'Unmapped / Unknown Product') as product_name,
                coalesce(category, 'Unassigned') as category,
                coalesce(subcategory, 'Unassigned') as subcategory,
                coalesce(p.cost, 0) as cost, last_sale_date,
                coalesce(s.sales, 0) as sales, coalesce(s.units, 0) as units,
                coalesce(s.orders, 0) as orders, coalesce(s.buyers, 0) as buyers,
                coalesce(s.before, 0) as before, coalesce(s.after, 0) as after,
                coalesce(s.sales, 0) - coalesce(p.cost * s.units, 0) as profit,
                {_months('first_sale', 'last_sale_date')} as lifespan,
                {_months('last_sale_date', _ANCHOR)} as recency,
                p.product_key is not null as known
            from dim_products p full join summary s on p.product_key = s.sold_key
        )""",
    )
    customer = _star(
        f"""
        select customer_key, customer_number, customer_name, age,
            case when age is null then 'Unknown / Missing Birthdate'
                when age >= 50 then '50 and above' when age >= 40 then '40-49'
                when age >= 30 then '30-39' when age >= 20 then '20-29'
                else 'Under 20' end as age_groups,
            sales as total_sales, orders as total_orders, units as total_quantity,
            products as total_products,
            coalesce({_rounded('sales', 'nullif(orders, 0)', 2)}, 0.0) as avg_order_value,
            last_order_date,
            lifespan as lifespan_months,
            coalesce({_rounded('sales', '(lifespan + 1)', 2)}, 0.0) as avg_monthly_spend,
            before as sales_1999, after as sales_2000,
            {_GROWTH} as customer_yoy_sales_growth_rate,
            coalesce(favourite, 'No Purchases') as preferred_product_category,
            case when tenure >= 12 then 'Established Relationship'
                when tenure >= 4 then 'Mid-Stage Relationship'
                else 'New Relationship' end as customer_loyalty_tier,
            case when sales is null and (idle < 3 or idle = 3 and tenure > 3)
                    then 'Review Logic / Unsegmented'
                when tenure <= 3 then
                    case when idle >= 3 then 'Cold New Lead'
                        when sales > 5000 then 'New VIP (Shooting Star)'
                        when sales >= 1000 then 'New Account (Growth Driver)'
                        else 'Standard New (Low Spend)' end
                when idle >= 12 then 'Lost / Inactive'
                when idle >= 4 then 'At Risk / Slipping'
                when sales <= 5000 then 'Regular Core Base'
                when tenure >= 12 and idle <= 2 then 'Core VIP (Established)'
                else 'Core VIP (Cooling Down)' end as detailed_customer_segment
        from facts""",
        f"""base as (
            select f.*, c.customer_key as known_key, category
            from fact_sales f
            left join dim_customers c on c.customer_key = f.customer_key
            left join dim_products p on p.product_key = f.product_key
            where order_date is not null
        ), favourites as (
            select known_key, category as favourite
            from (select known_key, category, sum(sales_amount) as spend
                  from base where category is not null and known_key is not null group by all)
            qualify row_number() over (
                partition by known_key order by spend desc nulls last, category) = 1
        ), totals as (
            select known_key, count(distinct order_number) as orders,
                count(distinct product_key) as products, max(order_date) as last_order_date,
                sum(sales_amount)::bigint as sales, sum(quantity)::bigint as units,
                {_months('min(order_date)', 'max(order_date)')} as lifespan,
                {_months('max(order_date)', _ANCHOR)} as idle,
                {_months('min(order_date)', _ANCHOR)} as tenure,
                if(known_key is null, 0, {_yearly(1999)}) as before,
                if(known_key is null, 0, {_yearly(2000)}) as after
            from base group by known_key
        ), facts as (
            select t.*, c.customer_key, customer_number,
                coalesce(first_name, '') || ' ' || coalesce(last_name, '') as customer_name,
                {_years('birthdate', _ANCHOR)} as age, favourite
            from totals t
            left join dim_customers c on c.customer_key = t.known_key
            left join favourites v on v.known_key = t.known_key
        )""",
    )
    return {"product_performance": product, "customer_behavior": customer}


def statements() -> dict[str, str]:
    parts = [
        _ingestion(), _quality(), _exploration(), _magnitude(), _ranking(), _trend(),
        _cumulative(), _shares(), _segments(), _reports(),
    ]
    return {name: sql for part in parts for name, sql in part.items()}
