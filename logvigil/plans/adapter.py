"""The driver's ``events`` table seen as a security log.

All arithmetic is on integers, so the same text in another SQL engine gives the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.session import prepare

INVESTIGATIONS = 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(events: DataFrame, investigations: int = INVESTIGATIONS) -> DataFrame:
    """One log row per event; time is compressed so that 30 days become one."""
    return (
        events.withColumn("src_group", F.expr("user_id div 10"))
        .withColumn("at", F.expr("unix_micros(cast(ts as timestamp)) - 1704067200000000"))
        .selectExpr(
            f"concat('inv-', src_group % {investigations}) as investigation_id",
            "event_id",
            "timestamp_micros(1704067200000000 + at div 30) as timestamp",
            """case when event_id % 97 = 0
                 then concat_ws('.', '41', (event_id div 65536) % 256,
                                (event_id div 256) % 256, event_id % 256)
                 else concat_ws('.', '196.25', src_group div 256, src_group % 256) end as src_ip""",
            """case event_id % 11
                 when 0 then concat('8.8.4.', user_id % 200)
                 when 1 then concat('portal', src_group, '.gov.za')
                 else concat_ws('.', '10', src_group % 200, user_id % 7, event_id % 29)
               end as dst_ip""",
            """case event_type
                 when 'error' then 'login_failed'
                 when 'purchase' then 'payment_transfer'
                 when 'signup' then if(event_id % 7 = 0, 'ussd_ewallet', 'fica_onboarding')
                 when 'click' then if(event_id % 17 = 0, 'prepaid_meter_update', 'connection')
                 else case when event_id % 13 = 0 then 'tor_proxy'
                           when event_id % 19 = 0 then 'municipal_ransomware'
                           else 'file_access' end
               end as event_type""",
            """case when src_group % 3 = 0
                 then 1000 + cast(get_json_object(props, '$.k') as int)
                 else element_at(array(443, 80, 22, 53), cast(event_id % 4 as int) + 1)
               end as dst_port""",
            "element_at(array('HTTPS', 'HTTP', 'SSH', ' dns ', null), "
            "cast(event_id % 5 as int) + 1) as protocol",
            "floor(value) * if(event_type = 'purchase', 300000.0D, 100.0D) as bytes_transferred",
            """if(user_id % 9 = 0, concat('svc_batch_', user_id), concat('user', user_id))
               as user_account""",
            "concat('PC-', user_id % 50) as device_id",
        )
    )


def telemetry_of(spark: SparkSession, sf_dir: str, investigations: int = INVESTIGATIONS) -> DataFrame:
    return telemetry(load(spark, sf_dir, "events"), investigations)
