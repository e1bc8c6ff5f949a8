"""Fixed values of the field, as defaults of the functions that take such lists."""

# Authorities, in the order they are searched for.
AUTHORITIES = (
    "国务院", "国务院办公厅", "工业和信息化部", "工信部", "财政部", "科技部", "教育部", "人力资源社会保障部", "人社部",
    "商务部", "农业农村部", "自然资源部", "生态环境部", "交通运输部", "住房城乡建设部", "水利部", "文化和旅游部",
    "国家卫生健康委", "国家发展改革委", "发改委", "国家税务总局", "海关总署", "市场监管总局", "国家统计局",
    "国家知识产权局", "国家药监局", "中国人民银行", "金融监管总局", "证监会", "国家中医药局", "国家民委", "国务院国资委",
)

# Categories and their keywords; earlier ones win ties.
CATEGORIES = {
    "融资支持": ("贷款", "贴息", "融资", "信贷", "担保", "投资", "基金"),
    "税收优惠": ("税收", "减税", "免税", "退税", "税率", "增值税", "所得税"),
    "人才政策": ("人才", "人力资源", "就业", "培训", "社保", "年金", "薪酬"),
    "产业扶持": ("产业", "制造", "工业", "互联网", "升级", "培育", "发展"),
    "科技创新": ("科技", "创新", "研发", "专利", "技术", "人工智能", "数字化"),
}

# Words that mark a line as a title.
TITLE_WORDS = ("关于", "办法", "通知", "意见", "方案", "规定", "条例", "公告", "计划")

# How lines of site noise begin, on pages and in Markdown or plain text.
PAGE_NOISE = (
    r"登录\s*\|?\s*注册", r"\d{4}年\d{1,2}月\d{1,2}日\s*星期", r"首页\s*Home", "政策文件库", "政策申报", "政策宣贯", "政策汇编",
    "政策图谱", "政策传播", "搜索$", r"易找\s*易懂", r"便捷\s*易享", r"汇编\s*聚焦", r"数据\s*服务", r"观点\s*监测", r"政策\s*活动",
    r"\s*\|\s*$", "首页.*政策详情$", "请输入政策标题$", "原文$",
)
TEXT_NOISE = (
    r"登录\s*\|?\s*注册", r"\d{4}年\d{1,2}月\d{1,2}日\s*星期", r"首页\s*Home", "首页$", "Home$", "政策文件库", "政策申报", "政策宣贯",
    "政策汇编", "政策图谱", "政策传播", "搜索$", r"易找\s*易懂", r"便捷\s*易享", r"汇编\s*聚焦", r"数据\s*服务", r"观点\s*监测",
    r"政策\s*活动", r"\s*\|\s*\|?\s*$", "首页.*政策详情", "请输入政策标题", "原文$", r"!\[.*\]\(.*\)$", r"\[登录", r"-\s*首页",
    r"-\s*政策文件", r"-\s*政策详情",
)

# Words that refer to what was said before.
REFERRING = ("它", "这个", "该", "那个", "上面", "前面", "刚才", "还有", "另外", "其他", "比较", "对比", "区别", "多少", "怎么", "什么时候")


def any_of(patterns):
    """One pattern for several."""
    return "|".join(patterns)
