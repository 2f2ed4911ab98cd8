"""Keywords of the domains that texts are sorted into."""

from __future__ import annotations

# Domains in order, with their keywords in Chinese and English.
CHINESE: dict[str, tuple[str, ...]] = {
    "technical": (
        "代码", "函数", "变量", "类", "接口", "api", "数据库", "服务器", "算法", "编程", "开发", "软件", "系统", "架构", "部署", "测试", "配置", "参数", "模块", "组件", "框架", "库", "依赖",
        "版本", "调试", "日志", "错误", "异常", "性能", "优化", "缓存", "并发",
    ),
    "legal": (
        "合同", "条款", "协议", "法律", "法规", "权利", "义务", "责任", "违约", "赔偿", "仲裁", "诉讼", "判决", "证据", "当事人", "甲方", "乙方", "签署", "生效", "终止", "解除", "保密", "知识产权",
        "著作权",
    ),
    "medical": (
        "患者", "诊断", "治疗", "症状", "药物", "手术", "病历", "检查", "化验", "医生", "护士", "医院", "门诊", "住院", "处方", "剂量", "副作用", "禁忌", "病理", "临床", "康复", "护理", "疾病",
        "健康",
    ),
    "financial": (
        "股票", "基金", "债券", "投资", "收益", "风险", "资产", "负债", "利润", "亏损", "财务", "报表", "审计", "税务", "贷款", "利率", "汇率", "交易", "账户", "结算", "融资", "估值", "市值",
        "分红",
    ),
    "academic": (
        "研究", "论文", "实验", "数据", "分析", "结论", "假设", "方法", "理论", "模型", "样本", "变量", "统计", "显著", "相关", "引用", "参考文献", "摘要", "关键词", "结果", "讨论", "综述", "学术",
    ),
    "news": (
        "报道", "记者", "消息", "新闻", "发布", "声明", "采访", "现场", "事件", "发生", "据悉", "据了解", "表示", "指出", "透露", "宣布", "预计", "分析人士", "业内人士", "相关人士", "今日", "昨日",
    ),
}
ENGLISH: dict[str, tuple[str, ...]] = {
    "technical": (
        "code", "function", "variable", "class", "interface", "api", "database", "server", "algorithm", "programming", "development", "software",
        "system", "architecture", "deploy", "test", "config", "parameter", "module", "component", "framework", "library", "dependency", "version",
        "debug", "log", "error", "exception", "performance", "optimize", "cache", "concurrent",
    ),
    "legal": (
        "contract", "clause", "agreement", "legal", "law", "regulation", "right", "obligation", "liability", "breach", "compensation", "arbitration",
        "litigation", "judgment", "evidence", "party", "execute", "effective", "terminate", "confidential", "intellectual property", "copyright",
    ),
    "medical": (
        "patient", "diagnosis", "treatment", "symptom", "drug", "surgery", "medical record", "examination", "test", "doctor", "nurse", "hospital",
        "outpatient", "inpatient", "prescription", "dosage", "side effect", "contraindication", "pathology", "clinical", "recovery", "care",
        "disease",
    ),
    "financial": (
        "stock", "fund", "bond", "investment", "return", "risk", "asset", "liability", "profit", "loss", "financial", "statement", "audit", "tax",
        "loan", "interest rate", "exchange rate", "transaction", "account", "settlement", "financing", "valuation", "market cap", "dividend",
    ),
    "academic": (
        "research", "paper", "experiment", "data", "analysis", "conclusion", "hypothesis", "method", "theory", "model", "sample", "variable",
        "statistic", "significant", "correlation", "citation", "reference", "abstract", "keyword", "result", "discussion", "review", "academic",
    ),
    "news": (
        "report", "reporter", "news", "press", "release", "statement", "interview", "scene", "event", "happen", "according", "source", "said",
        "noted", "revealed", "announced", "expected", "analyst", "insider", "today", "yesterday", "breaking",
    ),
}
DOMAINS = tuple(CHINESE)
