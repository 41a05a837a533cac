"""Texts attached to results. All of this module is fixed values: wording that reports must carry."""

# ---- fixed values --------------------------------------------------------------
UPSELL_ACTION = "Offer bundle discount or premium product"
DISRUPTION_ACTION = "Investigate supplier delays and consider alternative sources"
BOTTLENECK_ACTION = "Review staffing, equipment, and processes"
REORDER = "Reorder within %d days"
PRICING_REASON = "Low quantity sensitivity to price changes"

VALUE_SEGMENTS = {
    "high_value": (
        "High revenue, frequent purchases",
        ["VIP support", "Early access to features", "Personal account manager"],
    ),
    "medium_value": (
        "Moderate revenue and purchase frequency",
        ["Targeted promotions", "Product recommendations", "Engagement campaigns"],
    ),
    "low_value": (
        "Low revenue, infrequent purchases",
        ["Re-engagement campaigns", "Discount offers", "Onboarding support"],
    ),
}
BEHAVIOR_SEGMENTS = {
    "power_users": (
        "Frequent logins and purchases",
        ["Advocate program", "Beta testing invites", "Referral incentives"],
    ),
    "regular_users": (
        "Moderate engagement",
        ["Feature education", "Community engagement", "Progressive features"],
    ),
    "at_risk": (
        "High support tickets or low satisfaction",
        ["Proactive outreach", "Support quality review", "Retention offers"],
    ),
    "dormant": (
        "Low engagement",
        ["Re-engagement campaigns", "Win-back offers", "Feature highlights"],
    ),
}
LIFECYCLE_SEGMENTS = {
    "new": (
        "Customers ≤ 30 days old",
        ["Onboarding flow", "Tutorial content", "Early success milestones"],
    ),
    "active": (
        "Customers 31-90 days old, recent activity",
        ["Feature discovery", "Engagement encouragement", "Value reinforcement"],
    ),
    "mature": (
        "Customers > 90 days old",
        ["Advanced features", "Upsell opportunities", "Advocate programs"],
    ),
    "churned": (
        "No activity in 30+ days",
        ["Win-back campaigns", "Exit surveys", "Churn analysis"],
    ),
}

SENTIMENT_ACTIONS = {
    "recover": [
        "Conduct immediate customer feedback analysis",
        "Review recent product/service changes",
        "Increase support resources",
        "Create customer satisfaction improvement task force",
    ],
    "improve": [
        "Analyze detractors for common themes",
        "Implement targeted improvements",
        "Monitor satisfaction closely",
    ],
    "reinforce": [
        "Identify drivers of improvement",
        "Double down on successful initiatives",
        "Share learnings across teams",
    ],
    "maintain": [
        "Continue current engagement strategies",
        "Look for incremental improvements",
        "Monitor for changes",
    ],
}

RETENTION_ACTIONS = {
    "excellent": [
        "Document and share best practices",
        "Invest in customer success team",
        "Expand into new markets",
    ],
    "good": [
        "Identify drivers of expansion",
        "Focus on upsell opportunities",
        "Reduce churn risks",
    ],
    "healthy": [
        "Maintain current strategies",
        "Monitor for changes",
        "Incremental improvements",
    ],
    "concerning": [
        "Analyze churn reasons",
        "Improve product/service fit",
        "Strengthen customer success",
    ],
    "critical": [
        "Urgent: Review churned customers",
        "Implement retention playbook",
        "Consider pricing/offer changes",
    ],
}

SCENARIO_NOTES = {
    "marketing_up": "Monitor ROAS closely - high marketing spend requires >3x return",
    "marketing_down": "Warning: Reducing marketing may impact customer acquisition",
    "price_up": "Price increase >10% may reduce order frequency",
    "price_down": "Promotional pricing can boost volume but monitor margins",
    "staffing_up": "Additional staffing improves service speed - target peak hours",
    "staffing_down": "Reducing staff may increase prep times - monitor customer satisfaction",
    "none": "Current parameters are within optimal range",
}

CROSS_DOMAIN_RULES = [
    (
        "Revenue Growth & Customer Retention",
        ["sales", "customer", "revenue"],
        "Balancing revenue growth with customer retention",
        ["revenue_growth_rate", "customer_retention_rate", "churn_rate"],
    ),
    (
        "Inventory Optimization & Customer Satisfaction",
        ["operations", "customer"],
        "Stock availability impacts customer satisfaction",
        ["stockout_rate", "nps_score", "on_time_delivery_rate"],
    ),
    (
        "Pricing & Volume Optimization",
        ["sales", "revenue", "operations"],
        "Balancing pricing with volume and capacity",
        ["average_order_value", "total_revenue", "capacity_utilization"],
    ),
]
CROSS_DOMAIN_ACTION = "Analyze trade-offs and optimize jointly"

OPPOSING_WORDS = [
    ("reduce", "increase"),
    ("lower", "raise"),
    ("cut", "invest"),
    ("decrease", "grow"),
    ("minimize", "maximize"),
]
CONFLICT_CLASSES = [
    ("price", "pricing_trade_off"),
    ("cost", "cost_benefit_trade_off"),
    ("inventory", "inventory_optimization_trade_off"),
]
CONFLICT_OTHER = "resource_allocation_conflict"
RESOLUTION = "Prioritize %s recommendation due to higher priority score"
# ---- end of fixed values -------------------------------------------------------
