"""Thresholds, labels and dictionaries every result depends on."""

# Risk thresholds.
HIGH_RISK = 0.7
MEDIUM_RISK = 0.35
HIGH_REVENUE_AT_RISK = 50
MEDIUM_REVENUE_AT_RISK = 25

# Spellings of yes and no in the plan columns.
YES_WORDS = ("yes", "true", "1")
NO_WORDS = ("no", "false", "0")

# Main risk factors, in tie-break order.
CALLS_FACTOR = "Customer service calls >= 3"
DAY_FACTOR = "High day charge"
INTL_FACTOR = "International plan"
VOICE_FACTOR = "No voice mail plan"
STABLE_FACTOR = "Stable customer profile"
FACTOR_ORDER = (CALLS_FACTOR, DAY_FACTOR, INTL_FACTOR, VOICE_FACTOR, STABLE_FACTOR)

# Segments.
SERVICE_SEGMENT = "Service Issue Segment"
TARIFF_SEGMENT = "Tariff Optimization Segment"
INTL_SEGMENT = "International Usage Segment"
STABLE_SEGMENT = "Stable Customer Segment"

# Recommendation types and their reasons.
NO_ACTION = "No Action"
SERVICE_CALL = "Service Recovery Call"
INTL_REVIEW = "International Plan Review"
TARIFF_OFFER = "Tariff Optimization"
VOICE_OFFER = "Voice Mail Offer"
DISCOUNT = "Retention Discount"
REASONS = {
    NO_ACTION: "Customer has low churn probability; no retention action is required.",
    SERVICE_CALL: "Customer has many service calls; contact the customer to resolve issues.",
    INTL_REVIEW: "Customer uses an international plan; review international tariff conditions.",
    TARIFF_OFFER: "Customer has high day usage; offer a more suitable tariff plan.",
    VOICE_OFFER: "Customer has no voice mail plan; offer voice mail plan as a retention action.",
    DISCOUNT: "Customer has elevated churn probability; offer a retention discount.",
}

# The action a factor leads to, and the factor a segment or an action stands for.
FACTOR_ACTION = {
    CALLS_FACTOR: SERVICE_CALL,
    INTL_FACTOR: INTL_REVIEW,
    DAY_FACTOR: TARIFF_OFFER,
    VOICE_FACTOR: VOICE_OFFER,
}
SEGMENT_FACTOR = {
    SERVICE_SEGMENT: CALLS_FACTOR,
    TARIFF_SEGMENT: DAY_FACTOR,
    INTL_SEGMENT: INTL_FACTOR,
    STABLE_SEGMENT: STABLE_FACTOR,
}
ACTION_FACTOR = {
    SERVICE_CALL: CALLS_FACTOR,
    TARIFF_OFFER: DAY_FACTOR,
    INTL_REVIEW: INTL_FACTOR,
    VOICE_OFFER: VOICE_FACTOR,
}

# Health states as (highest score, code, label, tone).
HEALTH_STATES = (
    (35, "critical", "Критическое состояние", "red"),
    (60, "needs_attention", "Требует внимания", "amber"),
    (80, "stable", "Стабильный клиент", "blue"),
    (100, "healthy", "Здоровый клиент", "green"),
)

# Attention levels of a segment as (mean, share, customers, label, tone).
ATTENTION_LEVELS = (
    (0.7, 0.5, 10, "Критический приоритет", "red"),
    (0.35, 0.15, 3, "Требует внимания", "amber"),
)
ATTENTION_DEFAULT = ("Стабильный сегмент", "green")

# Per-minute rates and the columns they price.
MINUTE_RATES = {"day": 0.17, "eve": 0.085, "night": 0.045, "intl": 0.27}

# Label dictionaries of the exports.
RISK_GROUP_TEXT = {
    "High": "Высокий риск",
    "Medium": "Средний риск",
    "Low": "Низкий риск",
}
PRIORITY_TEXT = {
    "High": "Высокий",
    "Medium": "Средний",
    "Low": "Низкий",
}
FACTOR_TEXT = {
    "Customer service calls >= 3": "Обращений в поддержку ≥ 3",
    "International plan": "Подключён международный тариф",
    "High day charge": "Высокие дневные расходы",
    "No voice mail plan": "Не подключена голосовая почта",
    "Stable customer profile": "Фактор риска не выявлен",
}
SEGMENT_TEXT = {
    "High Service Contact Customers": "Клиенты с частыми обращениями в поддержку",
    "High Risk High Charge Customers": "Клиенты высокого риска с высокими расходами",
    "International Plan Users": "Клиенты с международным тарифом",
    "High Day Usage Customers": "Клиенты с высоким дневным использованием",
    "High Charge Customers": "Клиенты с высокими расходами",
    "High Churn Risk Customers": "Клиенты с высоким риском оттока",
    "Stable Customer Profile": "Клиенты со стабильным профилем",
}
ACTION_TEXT = {
    "No Action": "Без действия",
    "Service Recovery Call": "Звонок для восстановления сервиса",
    "International Plan Review": "Пересмотр международного тарифа",
    "Tariff Optimization": "Оптимизация тарифа",
    "Voice Mail Plan Offer": "Предложение голосовой почты",
    "Voice Mail Offer": "Предложение голосовой почты",
    "Retention Discount": "Скидка на удержание",
}
REASON_TEXT = {
    "Customer has many service calls; contact the customer to resolve issues.":
        "У клиента много обращений в поддержку; свяжитесь с клиентом, чтобы решить проблему.",
    "Customer uses an international plan; review international tariff conditions.":
        "Клиент использует международный тариф; проверьте условия международного тарифа.",
    "Customer has high day usage; offer a more suitable tariff plan.":
        "У клиента высокое дневное потребление; предложите более подходящий тарифный план.",
    "Customer has no voice mail plan; offer voice mail plan as a retention action.":
        "У клиента не подключена голосовая почта; предложите услугу как действие по удержанию.",
    "Customer has low churn probability; no retention action is required.":
        "У клиента низкая вероятность оттока; действие по удержанию не требуется.",
    "Customer has elevated churn probability; offer a retention discount.":
        "У клиента повышенная вероятность оттока; предложите скидку на удержание.",
}

# What the screens know beyond the export dictionaries.
SCREEN_FACTOR_TEXT = {
    **FACTOR_TEXT,
    "Customer service calls ≥ 3": "Обращений в поддержку ≥ 3",
    "International plan = Yes": "Подключён международный тариф",
    "High total day charge": "Высокие дневные расходы",
    "High international charge": "Высокие международные расходы",
    "Voice mail plan = No": "Не подключена голосовая почта",
    "No major risk factor": "Нет выраженного фактора риска",
    "High estimated total charge": "Высокие оценочные расходы",
}
SCREEN_SEGMENT_TEXT = {
    **SEGMENT_TEXT,
    "High Risk High Value Segment": "Высокий риск и высокая ценность",
    "High Risk Segment": "Высокий риск",
    "Service Issue Segment": "Сервисные проблемы",
    "Tariff Optimization Segment": "Тарифная оптимизация",
    "International Usage Segment": "Международное использование",
    "Stable Customer Segment": "Стабильные клиенты",
}
SCREEN_REASON_TEXT = {
    **REASON_TEXT,
    "No action required.": "Действие не требуется.",
}
SHORT_ACTION_TEXT = {
    "Service Recovery Call": "Восстановление сервиса",
    "Tariff Optimization": "Оптимизация тарифа",
    "Voice Mail Offer": "Голосовая почта",
    "Voice Mail Plan Offer": "Голосовая почта",
    "Retention Discount": "Скидка на удержание",
    "International Plan Review": "Международный тариф",
}

# Phrases that identify a reason, first match wins.
REASON_PHRASES = (
    (
        ("many service calls", "service calls"),
        "У клиента много обращений в поддержку; свяжитесь с клиентом, чтобы решить проблему.",
    ),
    (
        ("international plan", "international tariff", "international charges"),
        "Клиент использует международный тариф; проверьте условия международного тарифа.",
    ),
    (
        ("high day usage", "total day charge", "day charge"),
        "У клиента высокое дневное потребление или высокие дневные расходы; "
        "предложите более подходящий тарифный план.",
    ),
    (
        ("voice mail plan", "no voice mail"),
        "У клиента не подключена голосовая почта; предложите услугу как "
        "дополнительное действие по удержанию.",
    ),
    (
        ("low churn probability", "stable account"),
        "У клиента низкая вероятность оттока; явный фактор риска не выявлен.",
    ),
    (
        ("elevated churn probability", "retention discount"),
        "У клиента повышенная вероятность оттока; предложите скидку на удержание.",
    ),
    (
        ("high estimated total charge", "high total charge"),
        "У клиента высокая оценочная сумма расходов; рассмотрите индивидуальное "
        "удерживающее предложение.",
    ),
)

# Customer export columns in file order, with their headers.
EXPORT_HEADERS = {
    "customer_id": "ID клиента",
    "churn_probability": "Вероятность оттока",
    "risk_group": "Группа риска",
    "main_risk_factor": "Основной фактор риска",
    "estimated_total_charge": "Оценочные расходы",
    "revenue_at_risk": "Выручка под риском",
    "scoring_date": "Дата прогноза",
    "segment_name": "Сегмент",
    "recommendation_type": "Рекомендация",
    "recommendation_reason": "Причина рекомендации",
    "priority": "Приоритет",
}
