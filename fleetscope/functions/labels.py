"""Display names for result columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

# English word -> display word.
WORD_LABELS = {
    "instance": "实例",
    "name": "名称",
    "host": "主机",
    "version": "版本",
    "startup": "启动",
    "time": "时间",
    "status": "状态",
    "parallel": "并行",
    "patch": "补丁",
    "info": "信息",
    "memory": "内存",
    "component": "组件",
    "size": "大小",
    "parent": "父",
    "group": "组",
    "second": "第二",
    "parameter": "参数",
    "default": "默认",
    "order": "顺序",
    "minimum": "最小",
    "maximum": "最大",
    "path": "路径",
    "metric": "指标",
    "value": "值",
    "operation": "操作",
    "object": "对象",
    "type": "类型",
    "start": "开始",
    "end": "结束",
    "elapsed": "耗时",
    "con_id": "容器ID",
    "username": "用户名",
    "expiring": "将过期",
    "secs": "秒",
    "tablespace": "表空间",
    "temporary": "临时",
    "granted": "被授予",
    "role": "角色",
    "thread_id": "实例ID",
    "bytes": "字节",
    "archived": "已归档",
    "member": "成员",
    "name_y": "PDB名称",
    "name_x": "名称",
    "space": "空间",
    "free": "空闲",
    "usedbytes": "已用大小",
    "ten_min_timestr": "时间(10分钟)",
    "usage": "使用",
    "percent": "%",
}


def label(name: str, words: Mapping[str, str] = WORD_LABELS) -> str:
    """Label of a column: the whole name if listed, otherwise word by word."""
    whole = words.get(name.lower())
    if whole is not None:
        return whole
    return "_".join(words.get(part.lower(), part) for part in name.split("_"))


def rename_columns(df: DataFrame, words: Mapping[str, str] = WORD_LABELS) -> DataFrame:
    """Rename every column of ``df`` to its label."""
    return df.withColumnsRenamed({c: label(c, words) for c in df.columns})


def project_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Columns of ``wanted`` that ``df`` has; sources of older versions lack some."""
    have = set(df.columns)
    return df.select(*[f"`{c}`" for c in wanted if c in have])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
