"""Names, words, patterns and constants that results depend on.

Nothing here is logic.  The lists keep their natural order because the order
of feature names and of factors is part of the output contract.
"""

# Column names of the journal and of the dictionaries.
JOURNAL_COLUMNS = [
    "ид_события",
    "ид_канала_данных",
    "дата",
    "время",
    "тревожное",
    "значение_датчика",
]
RAW_COLUMNS = ["event_id", "channel_id", "raw_date", "raw_time", "alarm_raw", "value_raw"]
CHANNEL_KEY = "ид_канала_данных"
OBJECT_KEY = "ид_объект"
SENSOR_TYPE = "тип_датчика"
SYSTEM_TYPE = "тип_инж_системы"
SENSOR_NAME = "название_датчика"
SYSTEM_TAG = "тег_инженерной_системы"
OBJECT_NAME = "диспетчерское_название_объекта"
STATE_SET = "ид_набор_состояний"
STATE_NAME = "название_состояния"
STATE_ALARM = "тревожное"

# Column names of the prepared (already typed) journal.
PREPARED_EVENT_ID = ["ид_события_raw", "ид_события"]
PREPARED_CHANNEL_ID = ["ид_канала_данных_raw", "ид_канала_данных"]
PREPARED_ALARM_RAW = "тревожное_raw"
PREPARED_VALUE_RAW = "значение_raw"
PREPARED_TS = "datetime"
PREPARED_ALARM = "тревожное"
PREPARED_NUM = "значение_num"
PREPARED_STATE = "состояние_text"

# Words of the alarm flag.
ALARM_TRUE = ["t", "true", "1", "да"]
ALARM_FALSE = ["f", "false", "0", "нет"]

# State words.
FAULT = "неисправен"
NORMAL = "норма"
POWER_OFF = "обесточен"
UNDEFINED = ["неопределен", "не определено"]
DISABLED = "отключено устройство"
SMOKE = "обнаружен дым"
GAS = "обнаружен газ"
FLOOD = "затоплен"
AMBIGUOUS = "ambiguous"
MISSING = "__MISSING__"
UNKNOWN = "unknown"

# Patterns that route a sensor type to a direction.
DIRECTION_PATTERNS = {
    "sensor": r"контакт|объ[её]мн|температур|дым|газ|^кд(?:\s|$)|датчик движения|тепловой датчик",
    "infrastructure": r"состояние насоса|состояние вентилятора",
    "smoke": r"дым",
}

# Measures of the daily table that are rolled up as counts.
COUNT_MEASURES = [
    "events",
    "alarms",
    "text_n",
    "fault_messages",
    "power_messages",
    "undefined_messages",
    "disabled_messages",
    "smoke_messages",
    "gas_messages",
    "flood_messages",
    "night_events",
    "unknown_alarm",
    "nonfinite_n",
]
NUMERIC_MEASURES = ["numeric_n", "numeric_mean", "numeric_std", "numeric_min", "numeric_max"]

# Constants of the panel and of the labels.
PANEL_WINDOWS = (1, 7, 30)
ACTIVE_WINDOWS = (7, 30)
LOOKBACK_DAYS = 30
MIN_HISTORY_DAYS = 30
HOURS_PER_DAY = 24
NIGHT_ENDS_AT_HOUR = 6
SESSION_GAP_MINUTES = 10
MONTHLY_LEAD_DAYS = 1
MONTHLY_HORIZON_DAYS = 31

# Constants of the episode features.
EPISODE_WINDOWS = (1, 7, 30, 90, 365)
EPISODE_LAGS = (6, 13, 20, 27)
CLOSE_WINDOWS = (30, 90)
SHORT_EPISODE_HOURS = 1.0 / 60

# Ratio features in contract order, each with its formula in SQL.
RATIO_FORMULAS = {
    "hours_since_explicit_state": "timestampdiff(MICROSECOND, last_state_ts, prediction_time) / 3.6e9",
    "alarm_share_1d": "alarms_1d / nullif(events_1d, 0)",
    "fault_share_7d": "fault_messages_7d / nullif(events_7d, 0)",
    "undefined_share_7d": "undefined_messages_7d / nullif(events_7d, 0)",
    "night_share_7d": "night_events_7d / nullif(events_7d, 0)",
    "numeric_share_7d": "numeric_n_7d / nullif(events_7d, 0)",
    "events_per_active_day_7d": "events_7d / nullif(active_days_7d, 0)",
    "events_per_active_day_30d": "events_30d / nullif(active_days_30d, 0)",
    "numeric_range_7d": "numeric_max_7d - numeric_min_7d",
    "numeric_range_30d": "numeric_max_30d - numeric_min_30d",
    "short_fault_share_90d": "short_fault_closes_90d / nullif(fault_closes_90d, 0)",
    "fault_start_ratio_7d_30d": "(fault_starts_7d / 7) / nullif(fault_starts_30d / 30, 0)",
    "fault_day_rate_30d": "fault_start_days_30d / 30",
    "fault_day_rate_90d": "fault_start_days_90d / 90",
    "fault_day_rate_365d": "fault_start_days_365d / 365",
    "starts_per_fault_day_30d": "fault_starts_30d / nullif(fault_start_days_30d, 0)",
    "fault_weekly_repeats": "fault_day_lag_6 + fault_day_lag_13 + fault_day_lag_20 + fault_day_lag_27",
}

# Feature lists of the scoring contract.
SENSOR_FEATURES = [
    "events_1d",
    "events_7d",
    "events_30d",
    "alarms_7d",
    "fault_messages_30d",
    "undefined_messages_7d",
    "disabled_messages_7d",
    "hours_since_last_event",
    "alarm_rate_7d",
    "event_ratio_1d_7d",
    "active_days_30d",
    "history_complete_days",
]
CONTRACT_FEATURES = SENSOR_FEATURES + [
    "fault_messages_1d",
    "fault_messages_7d",
    "alarms_1d",
    "alarms_30d",
    "power_messages_1d",
    "power_messages_7d",
    "power_messages_30d",
    "undefined_messages_1d",
    "undefined_messages_30d",
    "disabled_messages_1d",
    "disabled_messages_30d",
    "event_ratio_7d_30d",
    "active_days_7d",
    "night_events_7d",
    "text_n_7d",
]
NEVER_FEATURES = [
    "channel_id",
    "entity_id",
    "object_id",
    "sensor_type",
    "system_type",
    "object_id_current",
    "sensor_type_current",
    "system_type_current",
    "prediction_time",
    "target_start",
    "target_end",
    "first_seen",
    "last_seen",
    "channel_followup_48h",
    "global_complete_0_24h",
    "global_complete_24_48h",
    "sample_weight",
    "sampling_probability",
    "at_risk_with_history",
    "feature_max_ts",
    "last_state_ts",
    "next_start_after_24h",
    "monthly_weight",
]

# Targets and their horizons in hours.
HORIZON_HOURS = {
    "target_fault_24_48h": (24, 48),
    "target_monthly": (24, 744),
    "smoke_signal_24_48h": (24, 48),
}

# Factors shown with a prediction, feature -> label.
FACTOR_LABELS = {
    "fault_messages_30d": "Сообщений «Неисправен» за 30 дней",
    "undefined_messages_7d": "Неопределённых состояний за 7 дней",
    "alarms_7d": "Тревожных сообщений за 7 дней",
    "event_ratio_1d_7d": "Активность относительно средней за неделю",
    "smoke_messages_7d": "Сообщений о дыме за 7 дней",
    "smoke_messages_30d": "Сообщений о дыме за 30 дней",
    "channel_history_count": "История smoke-сигналов канала",
    "channel_history_rate": "Доля smoke-сигналов канала",
}

# Texts of the prediction card and of an automatic ticket.
RECOMMEND_HIGH = "Проверить журнал и запланировать диагностику"
RECOMMEND_WATCH = "Продолжить наблюдение"
RECOMMEND_NO_SCORE = "Проверить состояние и полноту данных"
RECOMMEND_SUFFIX = {
    "target_monthly": "; экспериментальный месячный прогноз, низкий балл не подтверждает исправность",
    "smoke_signal_24_48h": "; прогноз зарегистрированного сигнала дыма, не подтверждённый пожар",
}
AUTOMATIC_COMMENT = "Автоматическая заявка по прогнозу повышенного риска"

# Ticket status changes that are allowed.
TICKET_CHANGES = {
    "new": ["in_progress", "dismissed"],
    "in_progress": ["done", "dismissed"],
    "done": [],
    "dismissed": [],
}
OPEN_STATUSES = ["new", "in_progress"]

# Fields of the spreadsheet export.
EXPORT_FIELDS = [
    "id",
    "direction",
    "entity_id",
    "object_name",
    "sensor_type",
    "system_type",
    "sensor_name",
    "system_tag",
    "prediction_time",
    "target_start",
    "target_end",
    "score",
    "risk",
    "model_version",
    "mode",
]

# Maintenance actions.
PLAN_ACTIONS = ["ТО", "ТР", "ТО+ТР"]

# What each measure and each extra feature means.
MEASURE_TEXT = {
    "events": "Количество зарегистрированных сообщений",
    "alarms": "Сообщения с исходным флагом тревоги",
    "text_n": "Нечисловые сообщения",
    "fault_messages": "Сообщения Неисправен",
    "power_messages": "Сообщения Обесточен",
    "undefined_messages": "Неопределен / Не определено",
    "disabled_messages": "Отключено устройство",
    "smoke_messages": "Обнаружен дым",
    "gas_messages": "Обнаружен газ",
    "flood_messages": "Затоплен",
    "night_events": "Сообщения в 00:00-05:59 по времени источника",
    "unknown_alarm": "Сообщения с неизвестным флагом тревоги",
    "nonfinite_n": "Сообщения с NaN/Inf",
    "numeric_n": "Количество конечных числовых показаний",
    "numeric_mean": "Взвешенное среднее числовых показаний",
    "numeric_std": "Стандартное отклонение, ddof=0",
    "numeric_min": "Минимум числовых показаний",
    "numeric_max": "Максимум числовых показаний",
}
EXTRA_TEXT = {
    "active_days_7d": "Дни с сообщениями за 7 суток",
    "active_days_30d": "Дни с сообщениями за 30 суток",
    "hours_since_last_event": "Часы после последнего известного сообщения",
    "history_days": "Дни от первого известного сообщения, не возраст оборудования",
    "alarm_rate_7d": "alarms_7d / events_7d",
    "event_ratio_1d_7d": "events_1d / (events_7d / 7)",
    "event_ratio_7d_30d": "(events_7d / 7) / (events_30d / 30)",
    "dow": "ISO день недели 1..7",
    "month": "Месяц 1..12",
    "dow_sin": "Циклическое кодирование дня недели, sin",
    "dow_cos": "Циклическое кодирование дня недели, cos",
    "history_complete_days": "Дни с глобальным потоком во всех 24 часах за предыдущие 30 дней",
    "global_complete_days_1d": "Полнота глобального потока предыдущих суток, 0/1",
    "global_complete_days_7d": "Дни с глобальным потоком во всех 24 часах за предыдущие 7 дней",
}
# What keys, labels and diagnostics of the panel mean, and when a column is known.
OTHER_TEXT = {
    "channel_id": "Строковый идентификатор канала; ключ, не признак",
    "prediction_time": "Момент расчёта, полночь",
    "target_start": "t + 24 часа",
    "target_end": "t + 48 часов, не включается",
    "sensor_type_current": "Тип из текущего справочника, историчность не подтверждена",
    "object_id_current": "Объект из текущего справочника",
    "system_type_current": "Система из текущего справочника",
    "feature_max_ts": "Последнее использованное событие, < t",
    "last_explicit_state": "Последнее Норма/Неисправен/ambiguous до t",
    "last_state_ts": "Время последнего явного изменения до t",
    "at_risk_with_history": "Норма до t, возраст наблюдения >=30 дней и полные предыдущие сутки",
    "channel_followup_48h": "Будущая наблюдаемость канала; запрещено в X",
    "global_complete_0_24h": "Поток во всех часах суток [t,t+24h); запрещено в X",
    "global_complete_24_48h": "Поток во всех часах целевых суток; запрещено в X",
    "first_seen": "Первое сообщение канала",
    "last_seen": "Последнее сообщение во всей выгрузке; запрещено в X",
    "target_fault_24_48h": "Новый эпизод Неисправен в [t+24h,t+48h); null = цензура",
    "target_fault_0_24h": "Новый эпизод в [t,t+24h); вспомогательная метка, запрещено в X",
}
KNOWN_BEFORE = "prediction_time; события строго раньше t"
KNOWN_LATER = "не входит в X; возможна информация будущего"
