"""Stop words of the sparse index."""

# Fixed values.
CHINESE = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "他", "她", "它", "们", "那", "些", "什么", "怎么", "这个", "那个", "但", "而", "或", "如果", "因为", "所以", "虽然", "但是", "可以", "能", "被", "把", "从", "对", "与", "以", "及",
    "等", "为", "于", "中", "之", "其", "帮", "帮我", "帮忙", "请", "请问", "麻烦", "查", "查下", "查一下", "查看", "看下", "看看", "看一下", "找", "找下", "找一下", "告诉", "告诉我", "想",
    "想要", "需要", "知道", "了解", "一下", "下", "哪些", "哪个", "哪里", "哪", "怎样", "怎么样", "如何", "为什么", "为何", "多少", "几个", "几", "谁", "吗", "呢", "吧", "啊", "嘛", "呀",
    "中有", "里面", "里", "上面", "下面", "左边", "右边", "前面", "后面", "这里", "那里", "哪里", "这些", "那些", "所有", "全部", "每个",
)
ENGLISH = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought", "and", "or", "but", "if", "while", "of", "at", "by", "for", "with", "about",
    "between", "through", "during", "before", "after", "above", "below", "to", "from", "in", "out", "on", "off", "over", "under", "this", "that",
    "these", "those", "it", "its", "not", "no", "nor", "what", "which", "who", "whom", "how", "where", "when", "why", "please", "help", "show",
    "find", "tell", "me", "my",
)
STOPWORDS = CHINESE + ENGLISH
