"""Domain constants.

The values below are fixed: results are only right if they equal the published rules, so
they are listed here as plain text and everything else refers to them by name.
"""

# Calendar -----------------------------------------------------------------

DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKEND_NAMES = ["Saturday", "Sunday"]
PEAK_HOURS = [(7, 9), (17, 19)]
NIGHT_BEFORE = 6
NIGHT_AFTER = 22

# Weather ------------------------------------------------------------------

WEATHER_CODE = {"Clear": 0, "Cloudy": 1, "Rain": 2, "Storm": 3}
WEATHER_FACTOR = {"Clear": 20, "Cloudy": 40, "Rain": 65, "Storm": 85}
WEATHER_DELAY_MINUTES = {"Clear": 0, "Cloudy": 5, "Rain": 15, "Storm": 30}
WEATHER_TREND_MULTIPLIER = {"Clear": 1.0, "Cloudy": 1.15, "Rain": 1.40, "Storm": 1.75}
WEATHER_CASE_DELAY = {"Clear": 1.0, "Cloudy": 1.15, "Rain": 1.40, "Storm": 1.85}
WEATHER_CASE_CANCEL = {"Clear": 0.01, "Cloudy": 0.03, "Rain": 0.08, "Storm": 0.22}
WEATHER_CASE_CASCADE = {"Clear": 1.0, "Cloudy": 1.1, "Rain": 1.3, "Storm": 1.8}
ALERT_WEATHER = ["Storm", "Heavy Rain"]

# Capacity -----------------------------------------------------------------

TERMINAL_GATES = {"T1": 8, "T2": 6, "T3": 5}
DEFAULT_GATES = 6
FLIGHTS_PER_GATE_HOUR = 3
TURNAROUND_MINUTES = 45
PASSENGERS_PER_FLIGHT = 180

# Carriers and class scores --------------------------------------------------

PREPARED_AIRLINES = ["Qatar Airways", "TunisAir", "Emirates", "Lufthansa"]
RISK_CLASS_SCORE = {"LOW": 20, "MEDIUM": 55, "HIGH": 90}
UNKNOWN_CLASS_SCORE = 50

# Recommendation texts for a predicted delay ---------------------------------

DELAY_ADVICE = {
    "LOW": "Normal operations",
    "MEDIUM": "Monitor closely, prepare for minor delays",
    "HIGH": "Consider schedule adjustment, notify passengers",
}

# Alert priorities and texts (printf patterns) --------------------------------

PRIORITY_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}

DELAY_ALERT = {
    "priority": "HIGH",
    "title": "Multiple High Delays Detected",
    "message": "%d flights delayed >%dmin",
    "details": "Airlines affected: %s",
    "actions": [
        "Notify affected airlines",
        "Update passenger information",
        "Consider schedule adjustments",
    ],
}
CONGESTION_ALERT = {
    "priority": "MEDIUM",
    "title": "High Passenger Congestion",
    "message": "Average congestion: %.0f passengers/hour",
    "details": "Peak at %d passengers",
    "actions": [
        "Deploy additional staff",
        "Open extra security lanes",
        "Monitor queue lengths",
    ],
}
WEATHER_ALERT = {
    "priority": "HIGH",
    "title": "Adverse Weather Alert: %s",
    "message": "Weather conditions may impact operations",
    "details": "Increased risk of delays and cancellations",
    "actions": [
        "Activate weather contingency plan",
        "Coordinate with ground services",
        "Update flight schedules",
    ],
}
GATE_ALERT = {
    "priority": "MEDIUM",
    "title": "Gate %s Overutilized",
    "message": "%d flights vs average %.1f",
    "details": "Consider redistributing flights",
    "actions": [
        "Move some flights from %s",
        "Review gate assignment algorithm",
        "Check for scheduling conflicts",
    ],
}

# Gate suggestion texts -------------------------------------------------------

GATE_SUGGESTION = {
    "action": "\U0001f500 Reassign flights from %s to %s",
    "reason": "%s has %.1f min avg delay",
    "impact": "Expected 25–40% delay reduction",
}
STANDING_SUGGESTIONS = [
    (
        "\U0001f4ca Implement dynamic gate assignment",
        "Static assignment causes bottlenecks",
        "Improve utilization by 15–20%",
        "MEDIUM",
    ),
    (
        "\U0001f552 Stagger schedules at peak gates",
        "T1-G1 and T2-G1 overloaded 8–10 AM",
        "Reduce congestion by 30%",
        "HIGH",
    ),
]
GATE_RECOMMENDATION = {
    "action": "Move flights from Gate %s to Gate %s",
    "reason": "Gate %s has %.1f min avg delay",
    "expected_improvement": "Reduce delays by 20-30%",
}

# Forecast warning text -------------------------------------------------------

PEAK_WARNING = "Expected %.1f min avg delay at %s"

# Capacity case recommendations (priority, action, impact) --------------------

CASE_ADVICE = {
    "redistribute": (
        "CRITICAL",
        "Redistribute %d flights to T2/T3",
        "Reduces gate overload to acceptable levels",
    ),
    "weather": (
        "HIGH",
        "Activate weather contingency protocol for %s",
        "Mitigate %s impact — pre-position de-icing/ground crew",
    ),
    "notify": (
        "HIGH",
        "Issue proactive passenger delay notifications",
        "Avg delay %d min expected — notify 2h in advance",
    ),
    "gates": (
        "MEDIUM",
        "Open %d additional gate(s) in %s",
        "Increase throughput capacity by 15–25%",
    ),
    "rebook": (
        "MEDIUM",
        "Pre-arrange rebooking for ~%d expected cancellations",
        "Reduce passenger disruption and complaint volume",
    ),
    "stagger": (
        "MEDIUM",
        "Stagger departure slots by 10–15 min intervals",
        "Smooth peak load and reduce cascade delays",
    ),
    "none": (
        "LOW",
        "Normal operations — standard monitoring sufficient",
        "No immediate action required",
    ),
}
