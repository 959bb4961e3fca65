"""What the models call random: held-out ordinary runs of many kinds against random keys, trained on small and on odd corpora."""

import random
import string

import pytest

from storyline.llm import secret_scan

#: None of these is among the training samples.
ORDINARY = """
getApplicationContextFromServletRequest ThreadPoolExecutorRejectedHandler defaultTransactionIsolationLevel isAuthenticatedViaSingleSignOn setOnItemSelectedListener
BufferedInputStreamReaderFactory XMLSchemaValidationException useLayoutEffectCallback mapStateToPropsWithRouter CustomerInvoiceLineItemAggregate
read_only_root_filesystem pg_stat_replication_slots spark_sql_shuffle_partitions SOCKET_CONNECT_TIMEOUT_MS AWS_DEFAULT_REGION_NAME test_rejects_unsigned_requests
content-transfer-encoding x-forwarded-for-header bootstrap-datetimepicker-build continuous-integration-pipeline left-navigation-bar-collapsed linux-image-generic-lts
/var/log/nginx/access_log_archive home/runner/work/project/build packages/core/src/components/Button docs/getting-started/installation etc/systemd/system/multi-user
1999-12-31T23-59-59Z 2031-07-04_08-15-00 20250314150926535 1700000000000000000 978-0-306-40615-7-paperback 192-168-100-200-255 v10-4-0-rc-2-build-77
f47ac10b-58cc-4372-a567-0e02b2c3d479 6BA7B810-9DAD-11D1-80B4-00C04FD430C8
________________________________ ================================ ++++++++++++++++++++ -=-=-=-=-=-=-=-=-=-= //////////////////// ZZZZZZZZZZZZZZZZZZZZZZZZ 00000000000000000000 xxxxxxxxxxxxxxxxxxxx
counterrevolutionaries uncharacteristically Geschwindigkeitsbegrenzung Bundesverfassungsgericht responsabilisation extraordinairement internacionalizaciones indiscriminadamente
qwertyuiopasdfghjkl abcdefghijklmnop ABCDEFGHIJKLMNOPQRSTUVWXYZ
""".split()
CORPORA = {
    "english": "the quick brown fox jumps over a lazy dog while many long names are plain and ordinary 2024 ",
    "odd": "zxq wvk 77 jjq ",
    "none": None,
}


@pytest.mark.parametrize("corpus", CORPORA)
def test_precision_and_recall(spark, corpus):
    model = secret_scan.train(spark.createDataFrame([(k, CORPORA[corpus] and CORPORA[corpus] * 30) for k in range(8)], "doc_id long, text string"))
    flagged = [w for w in ORDINARY if model.spans(w, [])]
    dice = random.Random(12)
    keys = ["".join(dice.choices(alphabet, k=n)) for alphabet in ("0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase, secret_scan.ALPHABET) for n in (16, 24, 40) for _ in range(100)]
    found = sum(bool(model.random(k)) for k in keys)
    assert found >= 0.97 * len(keys), found / len(keys)
    assert len(flagged) <= 0.05 * len(ORDINARY), flagged
