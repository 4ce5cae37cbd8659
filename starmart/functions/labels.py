"""The label texts that results carry."""

# Customer segments.
CORE_VIP = "Core VIP (Established)"
NEW_VIP = "New VIP (Shooting Star)"
GROWTH_DRIVER = "New Account (Growth Driver)"
STANDARD_NEW = "Standard New (Low Spend)"
COLD_LEAD = "Cold New Lead"
LOST = "Lost / Inactive"
AT_RISK = "At Risk / Slipping"
REGULAR = "Regular"
COOLING_VIP = "Core VIP (Cooling Down)"
REGULAR_CORE = "Regular Core Base"
UNSEGMENTED = "Review Logic / Unsegmented"

# Customer loyalty tiers.
NEW_RELATIONSHIP = "New Relationship"
MID_RELATIONSHIP = "Mid-Stage Relationship"
OLD_RELATIONSHIP = "Established Relationship"

# Customer age groups: upper bound and text.
AGE_GROUPS = [(19, "Under 20"), (29, "20-29"), (39, "30-39"), (49, "40-49")]
AGE_OLDEST = "50 and above"
AGE_UNKNOWN = "Unknown / Missing Birthdate"

NO_CATEGORY = "No Purchases"

# Catalogue cost ranges.
COST_LOW = "Below 100"
COST_MID = "100-500"
COST_HIGH = "500-1000"
COST_TOP = "Above 1000"

# Product defaults.
UNKNOWN_PRODUCT = "Unmapped / Unknown Product"
UNASSIGNED = "Unassigned"

# Product obsolescence.
DEAD_STOCK = "Dead Stock (Zero Lifetime Sales)"
FAST_MOVING = "Active / Fast-Moving"
SLOW_MOVING = "Slow-Moving (Watch List)"
NEAR_OBSOLETE = "At Risk / Approaching Obsolete"
OBSOLETE = "Obsolete / Dead Stock (12+ Months Inactive)"
UNMAPPED_SALE = "Unmapped Sales Transaction"

# Product lifetime revenue.
SALES_HIGH = "High-Performer (Lifetime)"
SALES_MID = "Mid-Range (Lifetime)"
SALES_LOW = "Low-Performer (Lifetime)"

# Product lifespan.
UNSOLD_ITEM = "Unsold Catalog Item"
SINGLE_MONTH = "Single-Month Burst"
SHORT_RUN = "Short Run (1-6 Months Active)"
STANDARD_RUN = "Standard Run (7-12 Months Active)"
EXTENDED_RUN = "Extended Run (12+ Months Active)"

# Product margin.
MARGIN_NONE = "No Sales Activity"
COST_MISSING = "Cost Data Missing (Unmapped Product)"
MARGIN_HIGH = "High Margin Driver (40%+)"
MARGIN_STABLE = "Stable Margin Core (15%-40%)"
MARGIN_LOW = "Low Margin / Volume Driver (0%-15%)"
MARGIN_LOSS = "Unprofitable Loss Leader (<0%)"

# Product profit volume.
PROFIT_MASSIVE = "Massive Cash Generator (>$20k)"
PROFIT_STEADY = "Steady Cash Contributor ($5k-$20k)"
PROFIT_MINOR = "Low Cash / Minor Contributor ($0-$5k)"
PROFIT_DRAIN = "Negative Cash Drain (<$0)"

# Product purchase frequency.
NEVER_BOUGHT = "No Purchases"
BOUGHT_ONCE = "One-Time Sale"
BOUGHT_SOMETIMES = "Occasional Purchase"
BOUGHT_OFTEN = "Repeat Purchase"
