"""The rule file that a review starts from: 65 items, each with the marker of its heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (marker, item) in the order of the file; rules and critical words are looked for in the items' text.
ITEMS: list[tuple[str, str]] = [
    ("SPLIT", "训练/验证/测试集的日期边界是否在代码中有明确注释？"),
    ("SPLIT", "测试集是否只跑过 1 次（未回头调参）？"),
    ("SPLIT", "策略选择是否在验证集上做的（不在测试集上）？"),
    ("SPLIT", "样本外测试的独立调仓次数是否 ≥ 12？"),
    ("SPLIT", "参数搜索范围是否记录在日志中？"),
    ("CLEAN", "异常值是否已 Winsorize（±5σ）？"),
    ("CLEAN", "停牌日是否已前向填充（≤3 天）？"),
    ("CLEAN", "复权是否已进行连续性校验（相邻日涨跌幅不超过 ±20%）？"),
    ("CLEAN", "是否存在因停牌超 3 天而被 drop 的数据段记录？"),
    ("CLEAN", "数据清洗日志是否输出了异常值/停牌/填充的统计量？"),
    ("MODEL_EVAL", "HMM 的 BIC/AIC 是否记录？"),
    ("MODEL_EVAL", "情绪模型的准确率（Accuracy）是否评估？"),
    ("MODEL_EVAL", "滚动窗口参数（vol, corr）是否基于扩窗历史计算？"),
    ("MODEL_EVAL", "回测结果是否包含了完整的评估指标（≥18 项）？"),
    ("OVERFIT", "是否计算了 Deflated Sharpe Ratio？"),
    ("OVERFIT", "是否计算了 PBO（Probability of Backtest Overfitting）？"),
    ("OVERFIT", "参数敏感性分析是否完成（至少 ±20%）？"),
    ("OVERFIT", "最佳策略 vs 次好策略的差距是否合理（差距过大 = 过拟合）？"),
    ("OVERFIT", "是否对比了等权 ETF 组合（不调仓）作为基线？"),
    ("COST", "佣金是否 ≥ 万 2.5？"),
    ("COST", "最低佣金（5 元）是否建模？"),
    ("COST", "滑点是否 ≥ 2bp？"),
    ("COST", "冲击成本是否随参与率非线性增长？"),
    ("COST", "年化换手率是否 ≤ 300%？"),
    ("COST", "无券商手续费时是否会 warn（不阻断）？"),
    ("META", "Meta-Learner 是否记录 ≥ 8 个季度的历史？"),
    ("META", "Builder/Critic 的信誉分是否在线更新？"),
    ("META", "被 REJECT 的提案权重是否自动切换到防守策略？"),
    ("E2E", "回测日志是否记录了每次调仓的 train_end, test_start, test_end？"),
    ("E2E", "策略池是否可注入（不硬编码策略列表）？"),
    ("E2E", "结果是否包含净值曲线 + 每步权重 + 状态标签？"),
    ("E2E", "全程不报错时，Critic 是否至少触发过 1 次 DOWNGRADE 或 REJECT？"),
    ("SURVIVOR", "回测标的包含目前已退市/合并的 ETF 吗？（若否，需记录说明）"),
    ("SURVIVOR", "数据获取是否使用历史成分股/ETF 列表而非当前快照？"),
    ("LOOKAHEAD", "HMM 是否只在训练集上 fit？（检查是否有全局标准化）"),
    ("LOOKAHEAD", "是否设置了 Purging gap（≥5 交易日）？"),
    ("LOOKAHEAD", "是否设置了 Embargo gap（≥10 自然日）？"),
    ("LOOKAHEAD", "滚动指标（vol, corr）是否基于扩窗历史计算而非全量数据？"),
    ("SNOOPING", "测试集只跑了 1 次（未回头调参）？"),
    ("SNOOPING", "参数搜索是否在验证集上完成（不在测试集上）？"),
    ("SNOOPING", "PBO 是否 < 0.3？"),
    ("SNOOPING", "Deflated Sharpe 对应的 p-value 是否 < 0.05？"),
    ("COST", "佣金是否 ≥ 万 2.5？"),
    ("COST", "最低佣金（5 元）是否建模？"),
    ("COST", "滑点是否 ≥ 2bp？"),
    ("COST", "冲击成本是否随参与率非线性增长？"),
    ("COST", "年化换手率是否 ≤ 300%？"),
    ("OUTLIER", "净值曲线是否在去掉极端日（±5σ 以外）后仍为正？"),
    ("OUTLIER", "月度收益贡献分布是否均匀？"),
    ("OUTLIER", "最大回撤是否由少数极端日引发？"),
    ("SHORT", "所有权重是否 ≥ 0？"),
    ("SHORT", "权重和是否 = 1（满仓）？"),
    ("SHORT", "单标的权重是否 ≤ 40%？"),
    ("STORY", "策略逻辑是否有明确的数学/统计依据？"),
    ("STORY", "是否对比了沪深 300 买入持有？"),
    ("STORY", "是否对比了等权 ETF 组合（不调仓）？"),
    ("STORY", "是否分牛/熊/震荡状态分别报告？"),
    ("STORY", "是否计算了扣除时间成本后的净超额收益？"),
    ("GLOBAL", "是否在全部数据上 fit 任何模型再\"回测\"？"),
    ("GLOBAL", "是否在测试集上跑完后回头调参？"),
    ("GLOBAL", "是否用全局 mean/std 做标准化？"),
    ("GLOBAL", "是否假设能以收盘价成交？"),
    ("GLOBAL", "是否忽略最低佣金？"),
    ("GLOBAL", "是否只报告 Sharpe？（必须包含 DSR 和 PBO）"),
    ("GLOBAL", "报告是否诚实（不编造好看的结果）？"),
]


def items(spark: SparkSession) -> DataFrame:
    """(item_no, marker, check), as sources.tables gives them for a rule file."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(ITEMS, 1)], "item_no int, marker string, check string")
