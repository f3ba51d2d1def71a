"""Fixed values written out once more, so that a slip in the library's own tables is seen."""

import pytest
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions import rules
from holdfast.operators import augment
from tests.helpers import one

# Expected thresholds, rates, ratios and orders.
NUMBERS = {
    "HIGH_RISK": 0.7, "MEDIUM_RISK": 0.35, "HIGH_REVENUE_AT_RISK": 50, "MEDIUM_REVENUE_AT_RISK": 25,
    "YES_WORDS": ("yes", "true", "1"), "NO_WORDS": ("no", "false", "0"),
    "MINUTE_RATES": {"day": 0.17, "eve": 0.085, "night": 0.045, "intl": 0.27},
    "ATTENTION_LEVELS": ((0.7, 0.5, 10, "Критический приоритет", "red"), (0.35, 0.15, 3, "Требует внимания", "amber")),
    "ATTENTION_DEFAULT": ("Стабильный сегмент", "green"),
    "HEALTH_STATES": (
        (35, "critical", "Критическое состояние", "red"), (60, "needs_attention", "Требует внимания", "amber"),
        (80, "stable", "Стабильный клиент", "blue"), (100, "healthy", "Здоровый клиент", "green"),
    ),
    "FACTOR_ORDER": (
        "Customer service calls >= 3", "High day charge", "International plan", "No voice mail plan",
        "Stable customer profile",
    ),
}
JITTER = {
    "DEFAULT_TARGET": 1800, "SCORING_SPLIT": "scoring_batch", "ACCOUNT_JITTER": 18, "MESSAGE_JITTER": 4,
    "SERVICE_CALL_JITTER": 1, "VOICE_FLIP": 0.04, "INTL_FLIP": 0.03,
    "MINUTE_JITTER": {"day": 0.18, "eve": 0.16, "night": 0.16, "intl": 0.22},
    "CALL_JITTER": {"day": 14, "eve": 14, "night": 14, "intl": 2},
    "DRAW_NAMES": (
        "day", "eve", "night", "intl", "voice_flip", "messages", "account", "intl_flip", "day_calls", "eve_calls",
        "night_calls", "intl_calls", "service_calls",
    ),
}
# Expected labels.
TEXTS = {
    "RISK_GROUP_TEXT": {"High": "Высокий риск", "Medium": "Средний риск", "Low": "Низкий риск"},
    "PRIORITY_TEXT": {"High": "Высокий", "Medium": "Средний", "Low": "Низкий"},
    "FACTOR_TEXT": {
        "Customer service calls >= 3": "Обращений в поддержку ≥ 3",
        "International plan": "Подключён международный тариф",
        "High day charge": "Высокие дневные расходы",
        "No voice mail plan": "Не подключена голосовая почта",
        "Stable customer profile": "Фактор риска не выявлен",
    },
    "ACTION_TEXT": {
        "No Action": "Без действия",
        "Service Recovery Call": "Звонок для восстановления сервиса",
        "International Plan Review": "Пересмотр международного тарифа",
        "Tariff Optimization": "Оптимизация тарифа",
        "Voice Mail Plan Offer": "Предложение голосовой почты",
        "Voice Mail Offer": "Предложение голосовой почты",
        "Retention Discount": "Скидка на удержание",
    },
    "EXPORT_HEADERS": {
        "customer_id": "ID клиента", "churn_probability": "Вероятность оттока", "risk_group": "Группа риска",
        "main_risk_factor": "Основной фактор риска", "estimated_total_charge": "Оценочные расходы",
        "revenue_at_risk": "Выручка под риском", "scoring_date": "Дата прогноза", "segment_name": "Сегмент",
        "recommendation_type": "Рекомендация", "recommendation_reason": "Причина рекомендации",
        "priority": "Приоритет",
    },
}


@pytest.mark.parametrize("name", list(NUMBERS))
def test_numbers(name):
    assert getattr(L, name) == NUMBERS[name]


@pytest.mark.parametrize("name", list(JITTER))
def test_jitter(name):
    assert getattr(augment, name) == JITTER[name]


@pytest.mark.parametrize("name", list(TEXTS))
def test_texts(name):
    assert list(getattr(L, name).items()) == list(TEXTS[name].items())


@pytest.mark.parametrize(
    "probability, group",
    [(0.0, "Low"), (0.3499, "Low"), (0.35, "Medium"), (0.6999, "Medium"), (0.7, "High"), (1.0, "High")],
)
def test_risk_groups(spark, probability, group):
    found = spark.range(1).select(rules.risk_group(F.lit(probability)).alias("group"))
    assert one(found)["group"] == group
