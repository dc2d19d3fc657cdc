"""Customer segments and the advice that belongs to each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names and strategy texts.
STRATEGIES = {
    "重要价值": "维护VIP待遇，提供专属折扣和提前体验",
    "潜力客户": "推荐高客单价新品，搭配满减活动刺激升级",
    "重要保持": "定向发放回归优惠券，降低复购门槛",
    "新客户": "引导二次消费，首单后3天内推送新客专享券",
    "重要挽留": "大力度折扣+人工触达，挽回高价值客户优先",
    "一般价值": "维持常规运营，低成本触达保持活跃度",
    "流失高价值": "重点挽回对象，电话/短信+大额优惠券组合",
    "流失客户": "低成本触达（短信/模板消息），顺其自然",
    "普通客户": "常规营销推送，提升消费频次",
}
# The shorter strategy texts of the segment table in the diagnosis.
SHORT_STRATEGIES = {
    "重要价值": "维护VIP，专属折扣",
    "潜力客户": "推荐高客单价新品",
    "重要保持": "定向发放回归优惠券",
    "新客户": "首单3天内引导复购",
    "重要挽留": "大力度折扣 + 人工触达",
    "一般价值": "常规运营维持活跃",
    "流失高价值": "电话/短信重点挽回",
    "流失客户": "低成本触达",
    "普通客户": "常规营销推送",
}
AT_RISK = ["重要挽留", "流失高价值"]
ORDINARY = "普通客户"

# The cells (recency, frequency, monetary) of the nine rules; others are ordinary.
SEGMENT_SCORES = {
    "重要价值": ["333", "332"],
    "潜力客户": ["323", "322"],
    "重要保持": ["313", "312", "213", "212"],
    "新客户": ["311"],
    "重要挽留": ["133", "132", "123", "122"],
    "一般价值": ["131", "121"],
    "流失高价值": ["113", "112"],
    "流失客户": ["111"],
}


def segment_of(r: Column, f: Column, m: Column) -> Column:
    scores = F.concat(*[x.cast("string") for x in (r, f, m)])
    label = F.lit(ORDINARY)
    for name, accepted in SEGMENT_SCORES.items():
        label = F.when(scores.isin(accepted), F.lit(name)).otherwise(label)
    return label


def text_for(segment: Column, texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[segment]
